"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit, a linear classifier over shares of hashed
byte n-grams says on which side a text is; the language whose codeword has the least total logistic loss
under all bits wins, so a few bits that are wrong are outvoted. Where the runner-up is close, the
answer is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import Counts, counted, sample
from .subwords import counts_by_row
from .tables import free_name, map_arrow, quoted, with_fields
from .texts import cuts, text_buffers

SIZES = (1, 2, 3)
BITS = 12
#: Rows that are learned from, at most.
TRAINING_ROWS = 4000
#: Losses nearer to one another than this flag an answer as ambiguous.
AMBIGUOUS = 0.5


def codewords(count: int, length: int = 15, seed: int = 7) -> np.ndarray:
    """``count`` rows of +1 and -1, far apart: of several random draws that with the largest least distance."""
    length = max(length, 4 * int(np.ceil(np.log2(max(count, 2)))))
    rng = np.random.default_rng(seed)
    best, apart = np.ones((count, length)), -1
    for _ in range(400):
        code = rng.choice([-1.0, 1.0], (count, length))
        code[:, 0] = np.where(np.arange(count) % 2, -1.0, 1.0)
        gaps = (length - code @ code.T) / 2
        least = gaps[~np.eye(count, dtype=bool)].min() if count > 1 else 0
        both = count <= 2 or (np.abs(code.sum(axis=0)) < count).all()  # each bit must tell some languages apart
        if both and least > apart:
            best, apart = code, least
    return best


@dataclass
class Coder:
    """Learned weights of the bits."""

    names: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray

    def losses(self, shares: np.ndarray) -> np.ndarray:
        """Total loss of each text under each language's codeword."""
        margins = np.clip(shares @ self.weights + self.bias, -8, 8)
        return (np.log1p(np.exp(-margins[:, None, :] * self.code[None])) * np.abs(margins)[:, None, :]).sum(axis=2)

    def decode(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and whether the runner-up is close."""
        losses = self.losses(shares)
        order = np.sort(losses, axis=1)
        close = order[:, 1] - order[:, 0] < AMBIGUOUS if losses.shape[1] > 1 else np.zeros(len(losses), bool)
        odds = np.exp(order[:, :1] - losses)
        return losses.argmin(axis=1), 1 / odds.sum(axis=1), close


def learn(counts: Counts, epochs: int = 12, rate: float = 0.5, seed: int = 11) -> Coder | None:
    """Logistic regression for each bit, by stochastic gradient steps with per-weight rates."""
    labels = counts.labels
    names = sorted(set(labels))
    if not names:
        return None
    code = codewords(len(names))
    y = code[[names.index(x) for x in labels]]
    share = np.array([labels.count(x) for x in names]) / len(labels)
    weight = (1 / (len(names) * share))[[names.index(x) for x in labels]]
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    w2, b2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            at = order[k : k + 64]
            x = counts.dense(at, 1 << BITS)
            margins = np.clip(x @ w + b, -30, 30)
            pull = (-y[at] / (1 + np.exp(margins * y[at])) * weight[at, None] / len(at)).astype(np.float32)
            grad, grad_b = x.T @ pull, pull.sum(axis=0)
            w2 += grad**2
            b2 += grad_b**2
            w -= rate * grad / np.sqrt(w2)
            b -= rate * grad_b / np.sqrt(b2)
    return Coder(names, code, w, b)


def train(docs: DataFrame, bound: int = TRAINING_ROWS) -> Coder | None:
    """A coder from rows with ``text`` and ``lang``; at most ``bound`` rows are used. None if there are none."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null")
    return learn(counted(sample(rows, "lang", bound), "lang", SIZES, False, BITS))


def identify(docs: DataFrame, coder: Coder | None) -> DataFrame:
    """The columns of ``docs`` but ``lang_pred``, ``score``, ``ambiguous``, with these added, from ``text`` alone.

    A text that is null or has no letter is ``und`` with score 1; so is every text, with score 0, if
    there is no coder. Added columns replace columns of the same name.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    schema = with_fields(docs.drop("text").schema, lang_pred=T.StringType(), score=T.DoubleType(), ambiguous=T.BooleanType())

    def tasks(batches):
        coder = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            letters = np.asarray(batch.column(1))
            name, score, close = [], [], []
            for i, j in cuts(offsets, 1 << 15) if coder else ():
                counts = counts_by_row(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SIZES, False, BITS)
                best, sure, near = coder.decode(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
                name += [coder.names[k] for k in best]
                score += sure.tolist()
                close += near.tolist()
            if not coder:
                name, score, close = ["und"] * len(letters), [0.0] * len(letters), [False] * len(letters)
            else:
                name, score = [x if ok else "und" for x, ok in zip(name, letters)], [x if ok else 1.0 for x, ok in zip(score, letters)]
                close = [bool(x and ok) for x, ok in zip(close, letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=[*kept, "lang_pred", "score", "ambiguous"])

    has_letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    lead = docs.select(F.col("text").cast("string").alias(free_name(docs, "text_")), has_letter.alias(free_name(docs, "letter_")), *[F.col(quoted(c)) for c in kept])
    return map_arrow(lead, tasks, schema)
