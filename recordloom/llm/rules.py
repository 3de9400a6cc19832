"""Quality rules: text statistics, and decision lists learned from labelled ones.

Sequential covering: a conjunction of thresholds is grown to cover rejected documents and few others,
pruned on documents that were held back, and what it covers is set aside; then the next one. The list is
emitted as one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import checkpointed, free_name, least_hashed, map_arrow, own_columns, with_fields
from .texts import Rolling, byte_codes, cuts, mix, same_spans, space_table, text_buffers, word_bounds, word_codes

#: Labelled rows that are learned from, at most.
TRAINING_ROWS = 20_000
#: Columns of statistics: counts, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_MARK[list(b".,;:!?")] = True


def _again(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (row, code): whether it stands in the row before, whether it stands there twice or more, and where first."""
    both = mix(code) ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse] != np.arange(len(code)), count[inverse] > 1, first[inverse]


def _plain_repeats(text: bytes, window: int) -> tuple[int, int, int]:
    """n_dup_lines, n_repeat_words and n_distinct_words of one text, without hashes."""
    words = text.translate(bytes(i if w else 0x20 for i, w in enumerate(space_table()))).split(b" ")
    words = [w for w in words if w]
    lines = Counter(x for x in text.split(b"\n") if space_table()[np.frombuffer(x, np.uint8)].any())
    of = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    cover = np.zeros(len(words) + 1, np.int64)
    for i in range(len(words) - window + 1):
        if of[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return sum(lines.values()) - len(lines), int((np.cumsum(cover[:-1]) > 0).sum()), len(set(words))


def count_stats(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> np.ndarray:
    """COUNTS of each text of a cut, a row each. What hashes call equal is compared byte by byte."""
    n = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets, space_table())
    codes = word_codes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(n + 1))

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags)]
        return sums[at[1:]] - sums[at[:-1]]

    inside = space_table()[data]
    # lines: what newlines and the ends of texts separate
    line = np.sort(np.r_[np.flatnonzero(data == 0x0A) + 1, offsets[:-1]])
    own = np.searchsorted(offsets, np.flatnonzero(data == 0x0A), "right") - 1
    line_row = np.sort(np.r_[own, np.arange(n)])
    order = np.lexsort((line, line_row))
    line, line_row = line[order], line_row[order]
    stop = np.r_[line[1:], len(data)]
    last = np.r_[line_row[1:] != line_row[:-1], True] if n else np.zeros(0, bool)
    stop = np.where(last, offsets[1:][line_row], stop - 1)
    words_before = np.r_[0, np.cumsum(inside)]
    wordy = words_before[stop] > words_before[line]
    line, stop, line_row = line[wordy], stop[wordy], line_row[wordy]
    repeated, _, was = _again(Rolling(byte_codes()[data]).slices(line, stop), line_row)
    again = np.flatnonzero(repeated)
    exact = np.array_equal((stop - line)[again], (stop - line)[was[again]]) and same_spans(data, line[again], line[was[again]], (stop - line)[again])
    # words in windows that stand in their text more than once
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(row[window - 1 :] == row[: len(row) - window + 1]) if len(row) >= window else np.zeros(0, np.int64)
    if len(at):
        _, twice, was = _again(Rolling(codes).windows(window)[at], row[at])
        span = np.arange(window)
        exact &= np.array_equal(codes[at[twice][:, None] + span], codes[at[was[twice]][:, None] + span])
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + window, -1)
    old_word, _, was = _again(codes, row)
    again, size = np.flatnonzero(old_word), ends - starts
    exact &= np.array_equal(size[again], size[was[again]]) and same_spans(data, starts[again], starts[was[again]], size[again])
    stats = np.stack([
        np.diff(bounds), per_row(inside & ((data & 0xC0) != 0x80), offsets), per_row(_SYMBOLS[data], offsets),
        np.bincount(line_row[repeated], minlength=n), per_row(np.cumsum(cover[:-1]) > 0, bounds), np.bincount(line_row, minlength=n),
        per_row(_UPPER[data], offsets), per_row(_DIGIT[data], offsets), per_row(_MARK[data], offsets), per_row(~old_word, bounds),
    ], axis=1).astype(np.int64)
    if not exact:  # a hash led astray
        stats[:, [3, 4, 9]] = [_plain_repeats(data[a:b].tobytes(), window) for a, b in zip(offsets[:-1], offsets[1:])]
    return stats


def with_stats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with COUNTS of ``text`` added, in place of columns of these names; a null text has none of anything."""
    docs = docs.drop(*COUNTS).withColumn("text", F.col("text").cast("string"))
    place, schema = docs.columns.index("text"), with_fields(docs.schema, **{c: T.LongType() for c in COUNTS})
    names = schema.names

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            parts = [count_stats(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in cuts(offsets)]
            stats = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, k]) for k in range(len(COUNTS)))], names=names)

    return map_arrow(docs, tasks, schema)


def features() -> dict[str, Column]:
    """What rules may compare with a threshold: shares and means made of the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
        "distinct": F.col("n_distinct_words") / words,
    }


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold): above means >= threshold, else <."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)
    rejected: int = 0
    kept: int = 0

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.conditions:
            out &= (x[name] >= t) if above else (x[name] < t)
        return out

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, t in self.conditions:
            out = out & ((of[name] >= F.lit(t)) if above else (of[name] < F.lit(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {t:.4g}" for n, a, t in self.conditions) or "always"


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, weight_of_kept: float) -> tuple[float, tuple[str, bool, float]] | None:
    """The threshold with the largest gain in the sense of FOIL."""
    p0, n0 = y.sum(), (~y).sum()
    best = None
    for name in sorted(x):
        order = np.argsort(x[name], kind="stable")
        value, is_p = x[name][order], y[order]
        cut = np.flatnonzero(value[1:] > value[:-1]) + 1
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(is_p)[cut - 1], np.cumsum(~is_p)[cut - 1]
        base = np.log2((p0 + 1e-9) / (p0 + weight_of_kept * n0 + 1e-9))
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(p > 0, p * (np.log2((p + 1e-9) / (p + weight_of_kept * n + 1e-9)) - base), -1)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), (name, above, float((value[cut[k]] + value[cut[k] - 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], rejected: np.ndarray, most: int = 12, precision: float = 0.9, least: int = 3, seed: int = 3) -> list[Rule]:
    """A decision list for ``rejected`` rows. A rule stays if at least ``precision`` of what it covers is rejected."""
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(rejected)), []
    while len(rules) < most and rejected[left].sum() >= least:
        draw = rng.random(len(left)) < 2 / 3
        grow, prune = left[draw], left[~draw]
        rule, live = Rule(), grow
        while rejected[live].any() and not rejected[live].all() and len(rule.conditions) < 4:
            found = _best_condition({k: v[live] for k, v in x.items()}, rejected[live], 1.0)
            if found is None or found[0] <= 0:
                break
            rule.conditions.append(found[1])
            live = grow[rule.covers({k: v[grow] for k, v in x.items()})]
        if not rule.conditions:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(conditions, held=held, prune=prune) -> float:
            hit = Rule(conditions).covers(held)
            p, n = rejected[prune][hit].sum(), (~rejected[prune][hit]).sum()
            return (p - n) / (p + n) if p + n else -1

        options = [rule.conditions[:k] for k in range(len(rule.conditions), 0, -1)]
        rule = Rule(max(options, key=lambda c: (worth(c), len(c))))
        hit = rule.covers({k: v[left] for k, v in x.items()})
        rule.rejected, rule.kept = int(rejected[left][hit].sum()), int((~rejected[left][hit]).sum())
        if rule.rejected < least or rule.rejected < precision * (rule.rejected + rule.kept):
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def sampled(labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """At most ``bound`` labels (doc_id, quality): those whose hash of doc_id is least. Null labels and ids are left out."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return least_hashed(marks, "doc_id", bound, "sample_order")


def train(stats: DataFrame, marks: DataFrame, bound: int = TRAINING_ROWS) -> list[Rule]:
    """Rules from ``stats`` (doc_id, COUNTS) and sampled() labels (quality 0 is rejected).

    Rows that share a doc_id all count, up to four times ``bound`` rows in all (those first by hash of the id); without any labelled row there are no rules.
    """
    rows = stats.select("doc_id", *COUNTS).join(F.broadcast(marks), "doc_id").select(*[c.alias(k) for k, c in features().items()], "quality", "sample_order")
    rows = rows.orderBy("sample_order", "quality", *features()).limit(4 * bound).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in features()}, (rows["quality"] == 0).to_numpy()) if len(rows) else []


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects, as one ordered conditional over COUNTS."""
    of, out = features(), None
    for rule in rules:
        out = F.when(rule.column(of), F.lit(False)) if out is None else out.when(rule.column(of), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words and the other COUNTS, base_failed, kept.

    kept is false where base_failed, else what the learned list says. Equal rows get equal verdicts, an
    empty table gives an empty one, and without labels only base_failed rejects.
    """
    stats = checkpointed(with_stats(docs.select("doc_id", "text")).drop("text"))
    rules = train(stats, sampled(labels, bound), bound)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their columns unchanged."""
    marks = sampled(labels, bound)
    labelled = docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")
    rules = train(with_stats(labelled).drop("text"), marks, bound)
    own = {c: free_name(docs, f"{c}_kept") for c in docs.columns if c in COUNTS}
    rows = with_stats(docs.withColumnsRenamed(own)).filter(~base_failed() & verdict(rules))
    back = {new: old for old, new in own.items()}
    return rows.drop(*COUNTS).withColumnsRenamed(back).select(*own_columns(docs))
