"""Document quality from supervised subword embeddings.

Every hashed word and byte n-gram has a learned vector; a document is the average of the vectors of
all its pieces, and a softmax layer on top gives the probability of good quality. Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import ORDER, Counts, counted, sample
from .subwords import pieces
from .tables import free_name, least_hashed, map_arrow, quoted, with_fields
from .texts import cuts, text_buffers

SIZES = (3, 4, 5)
BITS = 13
DIMENSIONS = 12
#: Rows that are learned from, at most.
TRAINING_ROWS = 4000


@dataclass
class Embeddings:
    """Learned vectors and output layer."""

    vectors: np.ndarray  # buckets x dimensions
    layer: np.ndarray  # dimensions x 2
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What one piece adds to the logit of class 1 against class 0, before averaging."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Softmax of the averaged vectors, from the sums of margins; a text without pieces has the bias only."""
        logit = sums / np.maximum(counts, 1) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def learn(counts: Counts, epochs: int = 15, rate: float = 0.3, seed: int = 5) -> Embeddings:
    labels, rng = counts.labels, np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares = [np.full_like(x, 1e-6) for x in (vectors, layer, bias)]
    y = np.eye(2, dtype=np.float32)[np.array(labels, np.int64)]
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 32):
            at = order[k : k + 32]
            x = counts.dense(at, 1 << BITS)
            hidden = x @ vectors
            logits = hidden @ layer + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            pull = (odds / odds.sum(axis=1, keepdims=True) - y[at]) / len(at)
            steps = (x.T @ (pull @ layer.T), hidden.T @ pull, pull.sum(axis=0))
            for value, square, step in zip((vectors, layer, bias), squares, steps):
                square += step**2
                value -= rate * step / np.sqrt(square)
    return Embeddings(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Embeddings:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1); at most ``bound`` documents are used."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # the labels' ids are sampled first, so that only these documents' texts move
    marks = least_hashed(marks.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", 2 * bound, ORDER).drop(ORDER)
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return learn(counted(sample(rows, "quality", bound), "quality", SIZES, True, BITS))


def score(docs: DataFrame, model: Embeddings) -> DataFrame:
    """The columns of ``docs`` but ``text`` and ``score``, with ``score`` (0 to 1, higher is better) added, from ``text`` alone.

    A null text is scored as an empty one.
    """
    docs = docs.drop("score")
    kept = [c for c in docs.columns if c != "text"]
    schema = with_fields(docs.drop("text").schema, score=T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches):
        model = shared.value
        margins = model.margins()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            out = [np.zeros(0)]
            for i, j in cuts(offsets):
                lo, hi = offsets[i], offsets[j]
                bounds = offsets[i : j + 1] - lo
                sums, counts = np.zeros(j - i), np.zeros(j - i)
                for at, bucket in pieces(data[lo:hi], bounds, SIZES, True, BITS):
                    row = np.searchsorted(bounds, at, "right") - 1
                    sums += np.bincount(row, margins[bucket], minlength=j - i)
                    counts += np.bincount(row, minlength=j - i)
                out.append(model.scores(sums, counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(out))], names=[*kept, "score"])

    lead = docs.select(F.col("text").cast("string").alias(free_name(docs, "text_")), *[F.col(quoted(c)) for c in kept])
    return map_arrow(lead, tasks, schema)
