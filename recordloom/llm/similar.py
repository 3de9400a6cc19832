"""Links between texts by the Jaccard similarity of their shingles: a complete search, every link verified.

Two sets of at least the given similarity share one of the first few shingles of each, in any one order of
all shingles (prefix filter), so pairs that share such a shingle are all that need be looked at. The order
is by hash, with shingles that many texts have behind all others. As it is random, the first SURE shingles will do
where most are not such: that they miss a pair is less likely than MISSED, and than a clash of two 64-bit hashes.

Pairs are taken in turns, and no turn makes more pairs than there are texts in groups. First come the links that
fingerprints propose. Then, ROUNDS times, each text takes the likeliest partner among those of its groups that it
is apart from. At last, texts that still have a possible partner they are apart from meet in their groups with
their whole sets, and what is similar is joined there. Two bounds, by size and by bits that tell the parity of
the number of shingles in each of many classes, discard pairs that cannot be similar enough.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import roots
from .tables import join_hot, partitions, stored
from .texts import Rolling, cuts, majority, mix, space_table, text_buffers, word_bounds, word_codes

#: Texts whose shingles tell which are common, how many of these must have one, and the most that are told apart.
SAMPLE, COMMON, MOST_COMMON = 4_000, 8, 50_000
#: Bits of parity, and of those that groups are searched with: the former laid over one another.
PARITY, NARROW = 4096, 512
#: Texts of one group that are held against as many others at once; larger groups are cut into such blocks.
BLOCK = 1024
#: Turns in which each text takes one partner.
ROUNDS = 1
#: The least share of shingles that are not common for a shorter prefix, and the chance to miss a pair by it.
RARE, MISSED = 0.6, 1e-18
#: Groups for each shuffle partition.
BUCKETS = 8
#: Bits of the filter on texts that are read again.
FILTER_BITS = 1 << 24


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text of a cut, in the order of the prefix filter, the n + 1 bounds, and how many are not common."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    data, n = table[data], len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets, space_table())
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    bounds = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(bounds)
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + shingle, np.repeat(bounds[1:], shingles))
    hashes, of = Rolling(word_codes(data, starts, ends)).slices(first, last), np.repeat(np.arange(n), shingles)
    late = np.zeros(len(hashes), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    order = np.lexsort((hashes, late, of))
    hashes, of, late = hashes[order], of[order], late[order]
    once = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]
    hashes, of, late = hashes[once], of[once], late[once]
    return hashes, np.searchsorted(of, np.arange(n + 1)), np.bincount(of[~late], minlength=n)


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at)) * PARITY + (hashes % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(of, minlength=n * PARITY) & 1).astype(bool).reshape(n, PARITY), axis=1)


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices values[at[i]:at[i + 1]] as binary values."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def prefix_size(n: np.ndarray, rare: np.ndarray, p: int, q: int) -> np.ndarray:
    """How many of n shingles (``rare`` not common) come first: n - ceil(n p / q) + 1, or fewer where that many are sure enough.

    Two similar sets differ in at most n (q - p) / p shingles of their union, so of RARE n that are not common at most
    the share ``odd``; each of the first ones, taken by hash, is a shared one but for that chance.
    """
    size = np.where(n > 0, n - -(-n * p // q) + 1, 0)
    odd = (q - p) / p / RARE
    if odd >= 1:
        return size
    return np.where(rare >= RARE * n, np.minimum(size, math.ceil(math.log(MISSED) / math.log(odd))), size)


def possible(na, nb, bits_a: np.ndarray, bits_b: np.ndarray, p: int, q: int) -> np.ndarray:
    """False for pairs whose sizes or parities show that they are less than p / q similar."""
    fit = np.minimum(na, nb) * q >= np.maximum(na, nb) * p
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return fit & (differ * (p + q) <= (na + nb) * (q - p))


def _lanes(column, bits: int) -> np.ndarray:
    """Parities as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, bits // 64)


def common_shingles(texts: DataFrame, code: str, shingle: int) -> np.ndarray:
    """Shingles that many of a sample of the texts have. They only order the search: no link depends on them."""
    n = texts.count()
    if n > SAMPLE:
        texts = texts.filter(F.col(code) < F.lit(int(-(1 << 63) + (1 << 64) * SAMPLE / n)).cast("bigint"))

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in cuts(offsets, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, np.zeros(0, np.uint64))[0].view(np.int64))], names=["token"])

    held = texts.select("text").mapInArrow(tasks, "token bigint").groupBy("token").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r.token for r in held.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def nodes_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set: the same for the same shingles in any order."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)]
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def described(texts: DataFrame, shingle: int, common: np.ndarray, p: int, q: int) -> DataFrame:
    """doc_id, code of each row (doc_id, text, code) with node (which set it has), n, fingerprint x, parities, and the prefix."""

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in cuts(offsets, 1 << 18):
                values, at, rare = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, common)
                n = np.diff(at)
                early = prefix_size(n, rare, p, q)
                rank = np.arange(len(values)) - np.repeat(at[:-1], n)
                prefix = values[rank < np.repeat(early, n)].view(np.int64)
                bits = parities(values, at)
                narrow = np.bitwise_xor.reduce(bits.reshape(-1, PARITY // NARROW, NARROW // 8), axis=1)
                x = np.zeros(len(n), np.uint64)
                x[n > 0] = majority(values, at[:-1][n > 0], n[n > 0])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(early)].astype(np.int32)), pa.array(prefix))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(nodes_of(values, at)), pa.array(n), pa.array(x.view(np.int64)), _binary(bits.ravel(), np.arange(j - i + 1) * (PARITY // 8)), _binary(narrow.ravel(), np.arange(j - i + 1) * (NARROW // 8)), lists],
                    names=["doc_id", "code", "node", "n", "x", "parity", "narrow", "prefix"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "code").mapInArrow(tasks, f"doc_id {kind}, code bigint, node bigint, n bigint, x bigint, parity binary, narrow binary, prefix array<bigint>")


def _groups(entries: DataFrame, common: list[int]) -> DataFrame:
    """(token, node) of the shingles that several nodes have in their prefix."""
    buckets = BUCKETS * partitions(entries.sparkSession)

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        token, node = frame["token"].to_numpy(), frame["node"].to_numpy()
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])][: len(token)]
        token, node = token[fresh], node[fresh]
        at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        size = np.diff(np.r_[at, len(token)])
        several = np.repeat(size > 1, size)
        return pd.DataFrame({"token": token[several], "node": node[several]})

    spark = entries.sparkSession
    marked = F.broadcast(spark.createDataFrame([(t,) for t in common], "token bigint"))
    few = entries.join(marked, "token", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    few = few.groupBy("bucket").applyInPandas(task, "token bigint, node bigint")
    return few.unionByName(entries.join(marked, "token", "left_semi").distinct())


def sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (distinct); only their texts are split again."""
    wanted = wanted.join(nodes.select("node", F.col("best.code").alias("code")), "node")
    slot = F.pmod("code", F.lit(FILTER_BITS))
    # as many bits as the filter has, whatever the number of rows
    parts = wanted.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    member = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in parts:
        member[part["part"] * 4096 : (part["part"] + 1) * 4096] = np.frombuffer(part["bits"], np.uint8)

    def tasks(batches):
        for batch in batches:
            code = batch.column(1).to_numpy(zero_copy_only=False)
            k = code % FILTER_BITS
            some = np.flatnonzero(member[k >> 3] >> (k & 7).astype(np.uint8) & 1)
            some = some[np.unique(code[some], return_index=True)[1]]
            if not len(some):
                continue
            data, offsets = text_buffers(batch.column(0).take(pa.array(some)))
            for i, j in cuts(offsets, 1 << 18):
                values, at, _ = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(values, at)), _binary(values, at)], names=["node", "shingles"])

    found = texts.select("text", "code").mapInArrow(tasks, "node bigint, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar_sets(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * q >= (len(x) + len(y) - shared) * p


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are at least p / q similar."""
    found = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, nodes, shingle)
    both = pairs.join(found.withColumnsRenamed({"node": "b", "shingles": "of_b"}), "b").join(found.withColumnsRenamed({"node": "a", "shingles": "of_a"}), "a")

    def judge(batches):
        for batch in batches:
            keep = [similar_sets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p, q) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "of_a", "of_b").mapInArrow(judge, "a bigint, b bigint"))


def _near(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) that the bounds do not discard."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "ab")

    def tasks(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                x, y = (_lanes(batch.column(c).to_pylist(), PARITY) for c in ("pa", "pb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(possible(na, nb, x, y, p, q)))

    return pairs.select("a", "b").join(b, "b").join(a, "a").mapInArrow(tasks, "a bigint, b bigint")


def _cells(groups: DataFrame, nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(bucket, cell, node, root, n, narrow) of groups whose texts are not all joined; large groups are dealt as pairs of blocks."""
    buckets = BUCKETS * partitions(groups.sparkSession)
    rooted = stored(groups.join(joined, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root")))
    apart = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    apart = apart.filter("low < high").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    dealt = join_hot(rooted, apart, "token").select("token", "node", "root", "blocks", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("node", "root", cell.alias("cell")).join(nodes.select("node", "n", "narrow"), "node")
    return dealt.withColumn("bucket", F.pmod("cell", F.lit(buckets)).cast("int"))


def possible_pairs(cell: np.ndarray, root: np.ndarray, n: np.ndarray, lanes: np.ndarray, p: int, q: int):
    """(i, j, differing parities) of places in one cell with different roots that the bounds do not discard; cell is sorted.

    All pairs at one distance at a time, in all cells at once.
    """
    at, step = np.arange(len(cell)), 1
    while True:
        at = at[: np.searchsorted(at, len(cell) - step)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            return
        i = at[root[at] != root[at + step]]
        na, nb = n[i], n[i + step]
        fit = np.minimum(na, nb) * q >= np.maximum(na, nb) * p
        i, room = i[fit], ((na + nb) * (q - p))[fit]
        differ = np.bitwise_count(lanes[i] ^ lanes[i + step]).sum(axis=1, dtype=np.int64)
        fit = differ * (p + q) <= room
        if fit.any():
            yield i[fit], i[fit] + step, differ[fit]
        step += 1


def _sorted(frame: pd.DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    frame = frame.sort_values(["cell", "node"], kind="stable")
    return (*(frame[c].to_numpy() for c in columns), frame)


def partners(cells: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): for each text of a cell the likeliest of its possible partners, if it has any."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        cell, node, root, n, frame = _sorted(frame, "cell", "node", "root", "n")
        best, other = np.full(len(cell), np.iinfo(np.int64).max), np.zeros(len(cell), np.int64)
        for i, j, differ in possible_pairs(cell, root, n, _lanes(frame["narrow"].tolist(), NARROW), p, q):
            for x, y in ((i, j), (j, i)):
                better = differ < best[x]
                best[x[better]], other[x[better]] = differ[better], node[y[better]]
        some = best < np.iinfo(np.int64).max
        a, b = np.minimum(node[some], other[some]), np.maximum(node[some], other[some])
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return cells.groupBy("bucket").applyInPandas(task, "a bigint, b bigint").distinct()


def remaining(cells: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """Links (a, b) that join all similar texts of a cell which are still apart, verified on the sets."""

    def open_by(column: str, width: int):
        def task(frame: pd.DataFrame) -> pd.DataFrame:
            cell, node, root, n, frame = _sorted(frame, "cell", "node", "root", "n")
            some = np.zeros(len(cell), bool)
            for i, j, _ in possible_pairs(cell, root, n, _lanes(frame[column].tolist(), width), p, q):
                some[i] = some[j] = True
            return frame.loc[some, ["bucket", "cell", "node", "root", "n"]]

        return task

    kinds = "bucket int, cell bigint, node bigint, root bigint, n bigint"
    active = cells.groupBy("bucket").applyInPandas(open_by("narrow", NARROW), kinds)
    active = stored(active.join(nodes.select("node", "parity"), "node").groupBy("bucket").applyInPandas(open_by("parity", PARITY), kinds))
    whole = active.join(sets(active.select("node").distinct(), texts, nodes, shingle), "node")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        cell, node, root, frame = _sorted(frame, "cell", "node", "root")
        held = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        size = np.array([len(x) for x in held])
        lanes = parities(np.concatenate([np.zeros(0, np.uint64), *held]), np.r_[0, np.cumsum(size)]).view(np.uint64)
        found, of = [np.zeros((0, 2), np.int64)], dict(zip(root.tolist(), root.tolist()))

        def top(r: int) -> int:
            while of[r] != r:
                of[r] = r = of[of[r]]
            return r

        for i, j, _ in possible_pairs(cell, root, size, lanes, p, q):
            for x, y in zip(i.tolist(), j.tolist()):
                one, two = top(root[x]), top(root[y])
                if one != two and similar_sets(held[x], held[y], p, q):
                    of[max(one, two)] = min(one, two)
                    found.append(node[[[x, y]]])
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"]).drop_duplicates()

    return whole.groupBy("bucket").applyInPandas(join, "a bigint, b bigint")


def similar_groups(texts: DataFrame, rows: DataFrame, nodes: DataFrame, common: np.ndarray, shingle: int, similarity: float, proposed: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are linked to another, over links of at least the similarity.

    ``proposed`` has pairs (a, b) to be looked at first; the result does not depend on them.
    """
    p, q = Fraction(str(similarity)).as_integer_ratio()
    entries = rows.select(F.explode("prefix").alias("token"), "node")
    groups = stored(_groups(entries, common.view(np.int64).tolist()))
    pairs = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sure = verified(stored(_near(pairs, nodes, p, q)), texts, nodes, shingle, p, q)
    for _ in range(ROUNDS):
        likely = stored(_near(partners(_cells(groups, nodes, stored(roots(sure))), p, q), nodes, p, q))
        sure = sure.unionByName(verified(likely, texts, nodes, shingle, p, q))
    cells = _cells(groups, nodes, stored(roots(sure)))
    return roots(sure.unionByName(remaining(cells, texts, nodes, shingle, p, q)))
