"""SimHash near-duplicates, found with pivot distance tables.

Every distinct fingerprint has a table of Hamming distances to reference fingerprints (pivots). Two
fingerprints within k bits have distances to any pivot that differ by k at most, so a pair with a larger
difference in any coordinate is discarded without looking at its bits, and survivors are verified.
Pairs to be tested come from cells: 64 bits in k + m blocks, of which a pair within k bits agrees on at
least m, so each fingerprint stands in one cell for each m blocks, and no link is lost for any m. The pipeline's
stage takes such links as proposals, verifies them on the shingles, and searches what they leave (similar.py).
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .components import roots
from .tables import checkpointed, free_name, join_hot, own_columns, partitions, quoted, stored, with_fields
from .texts import MULTIPLIER, cuts, majority, mix, space_table, text_buffers, word_bounds

#: Groups of cells for each shuffle partition: several small ones even out what a task gets and holds.
CELL_BUCKETS = 8
#: Reference fingerprints.
PIVOTS = 24
#: Fingerprints of a cell that are held against one another at once; a cell with more is dealt as pairs of blocks of so many.
BLOCK = 4096
#: Of all entries of cells, the part from which a cell is dealt in blocks: there are at most so many such cells.
MOST_BLOCKED = 100_000
#: Fingerprints that a cell should hold on average at most; more blocks have to agree where there are more.
CELL_SIZE = 256


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """SimHash of each text of a cut."""
    data, n_rows = _lowered()[data], len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets, space_table())
    out = np.zeros(n_rows, np.uint64)
    if not len(starts):
        return out
    # words of the cut, one blank after each
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(begin[-1] + size[-1]), 0x20, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    joined = joined.tobytes()
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(bounds)
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + shingle, np.repeat(bounds[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begin[first].tolist(), (begin[last] + size[last]).tolist())], np.uint64)
    rows = np.flatnonzero(shingles)
    out[rows] = majority(hashes, np.cumsum(shingles)[rows] - shingles[rows], shingles[rows])
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42, name: str = "x") -> DataFrame:
    """The columns of ``docs`` with the SimHash of ``text`` as a bigint; null and wordless texts get zero."""
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(name)
    place, schema = docs.columns.index("text"), with_fields(docs.schema, **{name: T.LongType()})
    columns = schema.names

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            parts = [fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, seed) for i, j in cuts(offsets, 1 << 18)]
            found = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=columns)

    return docs.mapInArrow(tasks, schema)


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: fixed values, spread over all bits."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(MULTIPLIER))


def distance_table(x: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    return np.stack([np.bitwise_count(x ^ p).astype(np.int8) for p in pivots(count)], axis=1)


def cell_links(cell: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one cell, enough to connect what is within ``bits`` of one another.

    cell is sorted. In every cell at once, a fingerprint takes out all that it is linked to, and these do so in
    turn; one that is left starts anew. So dense cells need few tests, and no cell gives more links than rows.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(cell))
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]) if len(cell) else at
    at = at[np.repeat(size, size) > 1]
    table = distance_table(x)
    reached = np.zeros(len(cell), bool)
    while len(at):
        first = np.flatnonzero(np.r_[True, cell[at[1:]] != cell[at[:-1]]])
        size = np.diff(np.r_[first, len(at)])
        # the next of each cell: one that was reached if there is any, else the first
        place = np.arange(len(at)) + np.where(reached[at], 0, len(at))
        one = np.minimum.reduceat(place, first) % len(at)
        rest = np.ones(len(at), bool)
        rest[one] = False
        of = at[np.repeat(one, size)]
        k = np.flatnonzero(rest & ~reached[at])
        for some in (slice(0, 4), slice(4, PIVOTS)):
            k = k[np.abs(table[at[k], some] - table[of[k], some]).max(axis=1, initial=0) <= bits]
        k = k[np.bitwise_count(x[at[k]] ^ x[of[k]]) <= bits]
        left.append(of[k])
        right.append(at[k])
        reached[at[k]] = True
        # what is alone, or has no one left that is not reached, is done
        open_ = np.add.reduceat((rest & ~reached[at]).astype(np.int64), first) > 0
        at = at[rest & np.repeat(open_, size)]
    return np.concatenate(left), np.concatenate(right)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def exact_masks(bits: int, agree: int = 2) -> list[int]:
    """Every ``agree`` of ``bits`` + ``agree`` blocks."""
    blocks = bits + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    of = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(some) for some in combinations(of, agree)]


def agreeing(n: int, bits: int) -> int:
    """How many blocks must agree for cells of CELL_SIZE of n fingerprints; any number gives the same links."""
    agree = 2
    while agree < 6 and n >> (64 * agree // (bits + agree)) > CELL_SIZE:
        agree += 1
    return agree


def links(nodes: DataFrame, bits: int, agree: int | None = None, block: int | None = None) -> DataFrame:
    """Edges (a, b) that connect fingerprints (column ``x``, column ``node`` their number) at ``bits`` or fewer differing bits."""
    n, block = CELL_BUCKETS * partitions(nodes.sparkSession), block or BLOCK
    rows = nodes.count()
    masks = exact_masks(bits, agree or agreeing(rows, bits))
    keys = [F.xxhash64(F.lit(k), F.col("x").bitwiseAND(F.lit(_signed(m)).cast("bigint"))) for k, m in enumerate(masks)]
    dealt = nodes.select("node", "x", F.explode(F.array(*keys)).alias("cell"))
    most = max(block, rows * len(masks) // MOST_BLOCKED)
    large = dealt.groupBy("cell").count().filter(F.col("count") > most).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # at most MOST_BLOCKED rows
    dealt = dealt.join(F.broadcast(large), "cell", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select("node", "x", cell.alias("cell")).withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int"))

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell", kind="stable")
        node, x = frame["node"].to_numpy(), frame["x"].to_numpy().view(np.uint64)
        left, right = cell_links(frame["cell"].to_numpy(), x, bits)
        return pd.DataFrame({"a": node[left], "b": node[right]}).drop_duplicates()

    return dealt.groupBy("bucket").applyInPandas(task, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 5, seed: int = 42) -> DataFrame:
    """Per row of ``docs`` (column ``text``, ``doc_id``): doc_id, fingerprint (hex), component_id.

    Words are what white space separates, A to Z lower-cased; a text of fewer words than ``shingle`` is
    one shingle; one without words (null, empty) has fingerprint zero, linked like any other.
    component_id is the least doc_id reached over links of at most ``bits`` differing bits, null where no
    reached row has a doc_id. Equal fingerprints meet as one node with its least doc_id, so copies cost nothing.
    """
    hashed = checkpointed(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle, seed).drop("text"))
    nodes = checkpointed(hashed.groupBy("x").agg(F.min("doc_id").alias("least")))
    found = roots(links(nodes.select(F.col("x").alias("node"), "x"), bits))
    merged = checkpointed(nodes.join(found, F.col("x") == F.col("node"), "left").select("x", "least", F.coalesce("root", "x").alias("root")))
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(join_hot(merged.select("x", "root"), least, "root").select("x", "component_id"))
    return join_hot(hashed, named, "x").select("doc_id", F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id.

    Linked are texts whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity``. SimHash
    fingerprints of the sets within ``bits`` propose links, each link is verified on the sets, and what is
    not yet in one group is searched completely (similar.py), so ``bits`` has no bearing on the result.
    Of rows with one doc_id the first by text, then any, stays. Groups in which no row has a doc_id keep
    one row too. Texts without words are alike. The columns of ``docs`` are returned unchanged.
    """
    p, q = Fraction(str(similarity)).as_integer_ratio()
    code, root, nth, stays_id, stays_code = (free_name(docs, c) for c in ("code", "root", "nth", "stays_id", "stays_code"))
    coded = docs.withColumn(code, F.xxhash64(F.col("text").cast("string")))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("code", F.xxhash64("text"))
    common = similar.common_shingles(texts, "code", shingle)
    rows = stored(similar.described(texts, shingle, common, p, q))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("code").alias("code")))
    nodes = stored(rows.groupBy("node").agg(best.alias("best"), *(F.first(c).alias(c) for c in ("n", "x", "parity", "narrow"))))
    proposed = links(nodes.select("node", "x"), bits)
    found = similar.similar_groups(texts, rows, nodes, common, shingle, similarity, proposed).withColumnRenamed("node", "linked")
    merged = nodes.join(found, F.col("node") == F.col("linked"), "left").select(F.coalesce("root", "node").alias(root), "best")
    stays = merged.groupBy(root).agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias(stays_id), F.col("best.code").alias(stays_code))
    kept = coded.join(stays, (F.col(code) == F.col(stays_code)) & F.col("doc_id").eqNullSafe(F.col(stays_id)), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", code).orderBy(F.lit(0)))
    return kept.withColumn(nth, first).filter(F.col(quoted(nth)) == 1).select(*own_columns(docs))
