"""Benchmark decontamination by Wu-Manber search for many word sequences at once.

Patterns are the windows of benchmark items. A block of two words indexes a table that says how far
the search may move on without missing a pattern; only where it says nothing may be skipped does the
hash of the last block and window select patterns, which are compared byte by byte. Inside a task the
search runs down many stretches of text side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import checkpointed, free_name, map_arrow, partitions, with_fields
from .texts import MULTIPLIER, Rolling, cuts, gathered, mix, text_buffers, word_bounds, word_codes

#: Ends of windows that one stretch of text holds.
STRETCH = 512
#: Bits of the shift table's index.
TABLE_BITS = 18
#: Benchmark text searched for at once, in bytes; a larger benchmark is searched for in blocks of this size.
BLOCK_BYTES = 32 << 20


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def alnum_table() -> np.ndarray:
    """True for bytes of words: digits, a to z, and all of other characters than ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows and codes of the words of lower-cased texts."""
    data = lowered()[data]
    starts, ends, row = word_bounds(data, offsets, alnum_table())
    return starts, ends, row, word_codes(data, starts, ends)


@dataclass
class Patterns:
    """Distinct sequences of ``length`` words and the items that hold each."""

    length: int
    words: np.ndarray  # patterns x length, codes
    at: np.ndarray  # items[at[p]:at[p + 1]] hold pattern p
    items: np.ndarray
    sizes: np.ndarray  # patterns x length, bytes of each word
    begin: np.ndarray  # text[begin[p]:] begins with the words of pattern p, nothing between them
    text: np.ndarray


def patterns_of(items: list[int | None], texts: list[str | None], width: int) -> list[Patterns]:
    """The windows of items, by length; an item of fewer words is one pattern, one of no words is none. Items may lack an id."""
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    begin, end, row, codes = words_of(data, offsets)
    data = lowered()[data]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    found: dict[int, tuple[list, list, list]] = {}
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        size = min(width, b - a)
        for i in range(a, b - size + 1) if size else ():
            words, own, places = found.setdefault(int(size), ([], [], []))
            words.append(codes[i : i + size])
            own.append(items[k])
            places.append(i)
    out = []
    for size, (words, own, places) in sorted(found.items()):
        distinct, first, inverse = np.unique(np.array(words), axis=0, return_index=True, return_inverse=True)
        known = np.array([x is not None for x in own], bool)
        pairs = np.unique(np.stack([inverse.ravel()[known], np.array([x for x in own if x is not None], np.int64)], axis=1), axis=0)
        at = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        span = np.array(places)[first][:, None] + np.arange(size)
        sizes = end[span] - begin[span]
        text = gathered(data, begin[span].ravel(), sizes.ravel())
        out.append(Patterns(size, distinct, at, pairs[:, 1], sizes, np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1), text))
    return out


class Searcher:
    """Shift table, suffix buckets and comparison for patterns of one length."""

    def __init__(self, patterns: Patterns):
        self.patterns, length = patterns, patterns.length
        self.block = min(2, length)
        self.mask = np.uint64((1 << TABLE_BITS) - 1)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        flat = Rolling(patterns.words.ravel())
        starts = np.arange(len(patterns.words)) * length
        blocks = self.blocks(patterns.words)
        for end in range(self.block, length + 1):
            place = (blocks[:, end - self.block] & self.mask).astype(np.int64)
            self.shift[place] = np.minimum(self.shift[place], length - end)
        # a bucket: the patterns with one hash of last block and whole sequence
        whole = flat.slices(starts, starts + length) ^ blocks[:, length - self.block]
        self.order = np.argsort(whole)
        self.suffix = whole[self.order]

    def blocks(self, words: np.ndarray) -> np.ndarray:
        """Codes of the blocks along the last axis."""
        return mix(words) if self.block == 1 else mix(words[..., :-1] * np.uint64(MULTIPLIER) + mix(words[..., 1:]))

    def same_bytes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether the words at each start are those of the pattern found there, byte by byte."""
        span = starts[:, None] + np.arange(self.patterns.length)
        size = end[span] - begin[span]
        out = (size == self.patterns.sizes[found]).all(axis=1)
        hit = np.flatnonzero(out)
        if len(hit):
            total = size[hit].sum(axis=1)
            equal = gathered(data, begin[span[hit]].ravel(), size[hit].ravel()) == gathered(self.patterns.text, self.patterns.begin[found[hit]], total)
            out[hit] = np.logical_and.reduceat(equal, np.cumsum(total) - total)
        return out

    def search(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray, bounds: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences inside the texts (words bounds[r]:bounds[r + 1]) and the patterns found there."""
        length, none = self.patterns.length, np.zeros(0, np.int64)
        if len(codes) < length:
            return none, none
        block = np.concatenate([np.zeros(self.block - 1, np.uint64), self.blocks(codes)])  # by the block's last word
        step = self.shift[(block & self.mask).astype(np.int64)]
        first, last = bounds[:-1] + length - 1, bounds[1:] - 1
        first, last = first[first <= last], last[first <= last]
        parts = (last - first) // STRETCH + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(first, parts) + nth * STRETCH
        stop = np.minimum(at + STRETCH - 1, np.repeat(last, parts))
        ends = [none]
        while len(at):
            move = step[at]
            ends.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at <= stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(ends)
        starts = ends - length + 1
        whole = rolling.slices(starts, ends + 1) ^ block[ends]
        place = np.minimum(np.searchsorted(self.suffix, whole), len(self.suffix) - 1)
        maybe = self.suffix[place] == whole
        starts, found = starts[maybe], self.order[place[maybe]]
        same = self.same_bytes(data, begin, end, starts, found)
        return starts[same], found[same]


def _occurrences(searchers: list[Searcher], data: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray, bounds: np.ndarray):
    """(start, length) of occurrences, and distinct (row, item)."""
    starts, lengths, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    rolling = Rolling(codes)
    for one in searchers:
        at, pattern = one.search(data, begin, end, codes, bounds, rolling)
        starts.append(at)
        lengths.append(np.full(len(at), one.patterns.length))
        row = np.searchsorted(bounds, at, "right") - 1
        row_pattern = np.unique(np.stack([row, pattern], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        size = np.diff(one.patterns.at)[row_pattern[:, 1]]
        items = gathered(one.patterns.items, one.patterns.at[row_pattern[:, 1]], size)
        pairs.append(np.stack([np.repeat(row_pattern[:, 0], size), items], axis=1))
    return np.concatenate(starts), np.concatenate(lengths), np.unique(np.concatenate(pairs), axis=0)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit (words inside occurrences) and items (item_ids, ascending) added.

    ``docs`` has ``text``, ``benchmark`` has ``item_id`` and ``text``. A null or wordless text has no words and no
    hits; items without words are not found anywhere; repeated items count once; items without an item_id are searched
    for like all others, but are not among the ids. Added columns replace columns of the same name. A benchmark of up to ``block_bytes`` goes to every task; a larger one does so
    block by block, and what the blocks found is brought together by row.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = docs.drop("n_words", "n_hit", "items")
    if blocks == 1:
        return _search(docs, [(r.item_id, r.text) for r in benchmark.collect()], width)
    row, where = free_name(docs, "row"), free_name(docs, "spans")
    docs = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    # blocks by a running sum of bytes, inside parts of the distinct items and then over the parts
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(partitions(spark)))
    items = checkpointed(benchmark.distinct().withColumns({"part": part, "size": F.octet_length("text")}))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = items.groupBy("part").agg(F.sum("size").alias("all")).select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("before"))  # a row for each part
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    numbered = items.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
    benchmark = checkpointed(numbered.select("item_id", "text", F.floor((F.col("before") + F.col("inside")) / block_bytes).alias("block")))
    found = None
    for k in sorted(r.block for r in benchmark.select("block").distinct().collect()):
        items = [(r.item_id, r.text) for r in benchmark.filter(F.col("block") == k).collect()]
        part = _search(docs.select(row, "text"), items, width, spans=True).filter("size(items) > 0").select(row, "spans", "items")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(where), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    words = _search(docs.select(row, "text"), [], width).select(row, "n_words")
    # spans are (start, end) of words; their union is counted
    joined = F.aggregate(
        F.array_sort(where), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: a["n"],
    )
    return (
        docs.join(words, row).join(found, row, "left")
        .withColumns({"n_hit": F.coalesce(joined, F.lit(0).cast("bigint")), "items": F.coalesce("items", F.array().cast("array<bigint>"))})
        .drop(row, where)
    )


def _search(docs: DataFrame, items: list[tuple[int, str]], width: int, spans: bool = False) -> DataFrame:
    """One block of the benchmark, searched for in all texts."""
    patterns = docs.sparkSession.sparkContext.broadcast(patterns_of([i for i, _ in items], [t for _, t in items], width))
    docs = docs.withColumn("text", F.col("text").cast("string"))
    place, span = docs.columns.index("text"), T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = with_fields(docs.schema, n_words=T.LongType(), n_hit=T.LongType(), items=T.ArrayType(T.LongType()), **({"spans": T.ArrayType(span)} if spans else {}))
    names = schema.names

    def tasks(batches):
        searchers = [Searcher(p) for p in patterns.value]
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            n_words, n_hit, found, where = [], [], [], []
            for i, j in cuts(offsets):
                lo, hi = offsets[i], offsets[j]
                begin, end, row, codes = words_of(data[lo:hi], offsets[i : j + 1] - lo)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                starts, lengths, pairs = _occurrences(searchers, lowered()[data[lo:hi]], begin, end, codes, bounds)
                cover = np.zeros(len(codes) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + lengths, -1)
                hits = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
                n_words += np.diff(bounds).tolist()
                n_hit += (hits[bounds[1:]] - hits[bounds[:-1]]).tolist()
                by_row = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
                found += [pairs[a:b, 1].tolist() for a, b in zip(by_row, by_row[1:])]
                if spans:
                    own = np.searchsorted(bounds, starts, "right") - 1
                    here: list[list] = [[] for _ in range(j - i)]
                    for r, s, n in zip(own.tolist(), (starts - bounds[own]).tolist(), lengths.tolist()):
                        here[r].append({"start": s, "end": s + n})
                    where += here
            arrays = [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            if spans:
                arrays.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(docs, tasks, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark, width, block_bytes)
    as_text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
