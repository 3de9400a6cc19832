"""MinHash near-duplicates by a multi-index Hamming join, every link confirmed on the whole shingle sets.

The signature of a set is VALUES numbers of one byte, each of the least hash of its shingles under another hash
function; two sets agree in a place with a probability of their Jaccard similarity. A signature is split into
CHUNKS chunks. By pigeonhole, two signatures that differ in at most REACH places differ in at most ERRORS places in
some chunk, so if every chunk is entered under all its ways to leave ERRORS places out, such signatures are sure to
meet. Sets of a similarity of 0.8 that meet nowhere are as rare as 0.4205**24, or 1e-9, and rarer the more similar
they are; pairs that meet are not looked at if they differ in over FAR places, which for such sets is as rare.

Cells (signatures with one key) are never expanded into pairs. Members of a cell form a chain, of which each task sends its
first one only, so a cell costs as many links as it has members and no member is in many. First each set is held
against the likeliest of its neighbours, then neighbours that are still apart, then, in cells that are still not of one
component, members of different components: first as many as would join these, at last what is apart for all that. Sizes and parities of the shingles in classes discard pairs that cannot
be similar, by bounds that hold for certain; what is left is confirmed on the sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import roots
from .similar import sets_of, similar_sets
from .tables import join_hot, partitions, stored
from .texts import MULTIPLIER, cuts, mix, text_buffers

#: Places of a chunk, chunks, and places of a chunk that may differ.
WIDTH, CHUNKS, ERRORS = 7, 24, 1
VALUES = WIDTH * CHUNKS
#: Differing places up to which two signatures are sure to meet.
REACH = (ERRORS + 1) * CHUNKS - 1
#: Differing places beyond which a pair that meets is not looked at: 6.5 standard deviations over what a similarity of 0.8 gives.
FAR = 67
#: Signatures that a task sends at once.
SEND = 16_384
#: Members of a cell that are held against as many others at once; larger cells are dealt as pairs of such blocks.
BLOCK = 1024
#: Pairs of one set that one place confirms.
PARTNERS = 64
#: Groups of cells for each shuffle partition.
BUCKETS = 4
#: Bits of the filter on texts that are read again.
FILTER_BITS = 1 << 24
#: Shingles worked on at once, so that a hash of each stays in a core's cache.
CACHED = 1 << 14
#: Bits of parity: at most, and for each shingle.
MOST_PARITY, PARITY_FACTOR = 1 << 16, 2


def _functions() -> np.ndarray:
    """Three 32-bit numbers for each hash function: fixed values, two of them odd."""
    x = mix(np.arange(1, 3 * VALUES + 1, dtype=np.uint64) * np.uint64(MULTIPLIER)).reshape(VALUES, 3)
    return (x >> np.uint64(32)).astype(np.uint32) | np.array([0, 1, 1], np.uint32)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, VALUES) bytes of sets values[at[i]:at[i + 1]]; an empty set has zeros."""
    out = np.zeros((len(at) - 1, VALUES), np.uint8)
    some = np.flatnonzero(np.diff(at))
    short, functions = (values >> np.uint64(32)).astype(np.uint32), _functions()
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(at[some + 1], at[some[i]] + CACHED, "right")))
        part, first = short[at[some[i]] : at[some[j - 1] + 1]], at[some[i:j]] - at[some[i]]
        for k, (a, b, c) in enumerate(functions):
            x = (part ^ a) * b
            x ^= x >> np.uint32(15)
            x *= c
            out[some[i:j], k] = (np.minimum.reduceat(x, first) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        i = j
    return out


def chunk_keys(signature: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """(sets, CHUNKS * WIDTH) keys: each chunk with one of its places left out, told by chunk and place; of one chunk of each set if ``only`` names it."""
    chunks, number = signature.reshape(len(signature), CHUNKS, WIDTH), np.arange(CHUNKS)
    if only is not None:
        chunks, number = chunks[np.arange(len(only)), only][:, None], only[:, None]
    chunks, number = chunks.astype(np.uint64), number.astype(np.uint64)
    keys = np.empty(chunks.shape, np.uint64)
    for out in range(WIDTH):
        rest = [k for k in range(WIDTH) if k != out]
        packed = sum((chunks[:, :, k] << np.uint64(8 * n) for n, k in enumerate(rest)), np.zeros(keys.shape[:2], np.uint64))
        keys[:, :, out] = packed | (number * np.uint64(WIDTH) + np.uint64(out)) << np.uint64(8 * (WIDTH - 1))
    return mix(keys.reshape(len(signature), keys.shape[1] * WIDTH))


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key that each two signatures share, of chunk_keys(); zero where there is none."""
    other = (x != y).reshape(len(x), CHUNKS, WIDTH)
    near_ = other.sum(axis=2) <= ERRORS
    chunk, row = near_.argmax(axis=1), np.arange(len(x))
    # the place that differs, or the first where none does
    out = other[row, chunk].argmax(axis=1)
    keys = chunk_keys(x, chunk)[row, out]
    return np.where(near_.any(axis=1), keys, np.uint64(0))


def set_codes(values: np.ndarray, at: np.ndarray, lane: int) -> np.ndarray:
    """A number for each set, the same for the same shingles in any order; other ones for each lane."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(values ^ mix(np.array([lane + 1]))), dtype=np.uint64)]
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def parities(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes whose bits tell the parity of the shingles in each class of each set, and their bounds: more classes for larger sets."""
    n = np.diff(at)
    bits = np.minimum(PARITY_FACTOR << np.frexp(np.maximum(n - 1, 31).astype(float))[1].astype(np.int64), MOST_PARITY)
    bounds = np.r_[0, np.cumsum(bits)]
    place = np.repeat(bounds[:-1], n) + (values & (np.repeat(bits, n).astype(np.uint64) - np.uint64(1))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bounds[-1]) & 1).astype(bool)), bounds // 8


class Parities:
    """Parity bytes of many sets, end to end."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = column.cast(pa.large_binary())
        _, bounds, data = values.buffers()
        self.at = np.frombuffer(bounds, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.size = np.diff(self.at)

    def odd(self, i: np.ndarray, other: Parities, j: np.ndarray) -> np.ndarray:
        """Classes in which sets i and sets j of ``other`` differ in parity; a finer table is folded onto a coarser one."""
        out, si, sj = np.zeros(len(i), np.int64), self.size[i], other.size[j]
        for one, two in set(zip(si.tolist(), sj.tolist())):
            k = np.flatnonzero((si == one) & (sj == two))
            small = min(one, two)
            x, y = (p.data[p.at[r[k]][:, None] + np.arange(n)].reshape(len(k), n // small, small) for p, r, n in ((self, i, one), (other, j, two)))
            out[k] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1, dtype=np.int64)
        return out


def possible(na: np.ndarray, nb: np.ndarray, x: np.ndarray, y: np.ndarray, odd, p: int, q: int) -> np.ndarray:
    """Whether pairs of sizes na, nb and signatures x, y may be p / q similar; ``odd(k)`` tells the odd classes of pairs k."""
    keep = (np.minimum(na, nb) * q >= np.maximum(na, nb) * p) & (differing(x, y) <= FAR)
    k = np.flatnonzero(keep)
    keep[k] = odd(k) * (p + q) <= ((na + nb) * (q - p))[k]
    return keep


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, code, same, n, signature, parity) of each row (doc_id, text, code); ``same`` tells which set it has, by 128 bits."""

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in cuts(offsets, 1 << 18):
                values, at, _ = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, np.zeros(0, np.uint64))
                same = pa.StructArray.from_arrays([pa.array(set_codes(values, at, lane)) for lane in (0, 1)], ["one", "two"])
                found = [same, pa.array(np.diff(at)), _binary(signatures(values, at).ravel(), np.arange(j - i + 1) * VALUES), _binary(*parities(values, at))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *found], names=["doc_id", "code", "same", "n", "signature", "parity"])

    return texts.select("doc_id", "text", "code").mapInArrow(tasks, "doc_id bigint, code bigint, same struct<one:bigint,two:bigint>, n bigint, signature binary, parity binary")


def _longs(column) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def _chains(key: np.ndarray) -> np.ndarray:
    """Places of neighbours of one key (place, place + 1); rows are sorted by key."""
    return np.flatnonzero(key[1:] == key[:-1])


def cells(nodes: DataFrame) -> DataFrame:
    """(key, a, b): the chain of each cell with several members; key is null for a cell of two, whose pairs come once a bucket."""
    buckets = BUCKETS * partitions(nodes.sparkSession)
    names = ["bucket", "key", "node", "of", "a", "b"]

    def send(node: np.ndarray, signature: np.ndarray):
        order = np.argsort(node)
        key = chunk_keys(signature[order])
        node = np.repeat(node[order], key.shape[1]).view(np.uint64)
        order = np.argsort(key.ravel(), kind="stable")
        key, node = key.ravel()[order], node[order]
        at = _chains(key)
        # members of a chain that this task sees it settles; the first one alone goes on
        own, local = np.ones(len(key), bool), np.zeros(len(key), bool)
        own[at + 1], local[at] = False, True
        # a bucket is a range of keys
        ends = np.searchsorted(key >> np.uint64(32), -(-(np.arange(buckets + 1) << 32) // buckets).astype(np.uint64))
        rows = {n: [] for n in names}
        for k in range(buckets):
            part = slice(ends[k], ends[k + 1])
            if ends[k] == ends[k + 1]:
                continue
            ours, links = own[part], np.flatnonzero(local[part]) + ends[k]
            for name, value in zip(names, (k, key[part][ours].tobytes(), node[part][ours].tobytes(), key[links].tobytes(), node[links].tobytes(), node[links + 1].tobytes())):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), **{n: pa.array(rows[n], pa.binary()) for n in names[1:]}})

    def tasks(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)))
            size += batch.num_rows
            if size >= SEND:
                yield send(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield send(*map(np.concatenate, zip(*held)))

    def meet(table: pa.Table) -> pa.Table:
        key, node, of, a, b = (_longs(table[n]) for n in names[1:])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        at = _chains(key)
        of, a, b = np.r_[of, key[at]], np.r_[a, node[at]], np.r_[b, node[at + 1]]
        _, back, size = np.unique(of, return_inverse=True, return_counts=True)
        two = size[back] == 1
        a, b = np.minimum(a, b), np.maximum(a, b)
        lone = np.unique(np.stack([a[two], b[two]]), axis=1)
        keys = pa.concat_arrays([pa.nulls(lone.shape[1], pa.int64()), pa.array(of[~two].view(np.int64))])
        return pa.Table.from_arrays([keys, pa.array(np.r_[lone[0], a[~two]].view(np.int64)), pa.array(np.r_[lone[1], b[~two]].view(np.int64))], names=["key", "a", "b"])

    sent = nodes.select("node", "signature").mapInArrow(tasks, "bucket int, key binary, node binary, of binary, a binary, b binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key bigint, a bigint, b bigint")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(axis=-1)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def near(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b, distance) of pairs that may be p / q similar."""
    of_a, of_b = (nodes.select(F.col("node").alias(c), F.struct("n", "signature", "parity").alias(f"of_{c}")) for c in "ab")

    def tasks(batches):
        for batch in batches:
            if batch.num_rows:
                n, signature, parity = zip(*(batch.column(c).flatten() for c in ("of_a", "of_b")))
                x, y = (_signatures(column) for column in signature)
                one, two = (Parities(column) for column in parity)
                keep = possible(n[0].to_numpy(), n[1].to_numpy(), x, y, lambda k: one.odd(k, two, k), p, q)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differing(x, y))], names=["a", "b", "distance"]).filter(pa.array(keep))

    return pairs.select("a", "b").join(of_b, "b").join(of_a, "a").mapInArrow(tasks, "a bigint, b bigint, distance bigint")


def sets(wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(same, shingles) of the wanted sets (distinct ``same`` and the code of a text that has it); other texts are not split again."""
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
                same = pa.StructArray.from_arrays([pa.array(set_codes(values, at, lane)) for lane in (0, 1)], ["one", "two"])
                yield pa.RecordBatch.from_arrays([same, _binary(values, at)], names=["same", "shingles"])

    found = texts.select("text", "code").mapInArrow(tasks, "same struct<one:bigint,two:bigint>, shingles binary")
    return found.groupBy("same").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets are at least p / q similar."""
    named = pairs.select("a", "b")
    for c in "ab":
        named = named.join(nodes.select(F.col("node").alias(c), F.struct("same", "code").alias(f"is_{c}")), c)
    named = stored(named)
    wanted = named.select(F.explode(F.array("is_a", "is_b")).alias("is")).select("is.code").distinct()
    found = sets(wanted, texts, shingle)
    both = named.select("a", "b", F.col("is_a.same").alias("a_is"), F.col("is_b.same").alias("b_is"))
    many = {}
    for c, other in ("ba", "ab"):
        # a set with many partners stands in several places, and its pairs are dealt to these
        places = both.groupBy(f"{c}_is").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("places"))
        many[c] = stored(places.filter("places > 1"))
        if many[c].isEmpty():
            both = both.withColumn(f"{c}_at", F.lit(0))
        else:
            both = stored(join_hot(both, places, f"{c}_is").withColumn(f"{c}_at", F.pmod(F.xxhash64(other), F.col("places")).cast("int")).drop("places"))
    for c in "ba":
        copies = found.withColumnRenamed("same", f"{c}_is").join(many[c], f"{c}_is", "left").withColumn(f"{c}_at", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)))
        both = both.join(copies.select(f"{c}_is", f"{c}_at", F.col("shingles").alias(f"of_{c}")), [f"{c}_is", f"{c}_at"])

    def judge(batches):
        for batch in batches:
            keep = [similar_sets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p, q) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "of_a", "of_b").mapInArrow(judge, "a bigint, b bigint"))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components (node, root)."""
    for c in "ab":
        pairs = pairs.join(joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def dealt(chains: DataFrame, open_: DataFrame, joined: DataFrame) -> DataFrame:
    """(bucket, key, cell, node, side): the members of all cells of three or more with a neighbouring pair in ``open_``.

    Of two members of different components (node, root) one at least is not of the component that most members have. So in a cell of
    more than BLOCK members the others are what is dealt out: each block of them with each block of that component (sides 1 and 0), and
    with each of their own blocks (side 2, as in small cells). Two of side 1 need not be held against each other.
    """
    buckets = BUCKETS * partitions(chains.sparkSession)
    larger = chains.filter("key is not null")
    keys = larger.join(open_, ["a", "b"], "left_semi").select("key").distinct()
    named = larger.join(keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = stored(named.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    by_root = members.groupBy("key", "root").count()
    size = by_root.groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("most"))
    # no blocks in a small cell; in a large one some of either kind
    parts = lambda n: F.when(F.col("n") > BLOCK, F.ceil(n / BLOCK)).otherwise(0).cast("int")
    size = size.filter(F.col("n") > F.col("most.count")).select("key", F.col("most.root").alias("main"), parts(F.col("most.count")).alias("of_main"), parts(F.col("n") - F.col("most.count")).alias("of_rest"))
    held = members.join(size.select("key"), "key", "left_semi")
    out = join_hot(stored(held), size, "key").withColumn("rest", F.col("root") != F.col("main"))
    out = out.withColumn("own", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("rest"), F.col("of_rest")).otherwise(F.col("of_main")), F.lit(1))).cast("int"))
    places = lambda n: F.sequence(F.lit(0), n - 1)
    row = lambda one, two, side: F.struct(one.alias("one"), two.alias("two"), F.lit(side).alias("side"))
    own, none = F.col("own"), F.lit(-1)
    with_main = F.transform(places(F.col("of_main")), lambda k: row(own, k, 1))
    with_rest = F.transform(places(F.col("of_rest")), lambda k: row(F.least(own, k), -2 - F.greatest(own, k), 2))
    seats = (
        F.when(F.col("of_main") == 0, F.array(row(none, none, 2)))
        .when(F.col("rest"), F.concat(with_main, with_rest))
        .otherwise(F.transform(places(F.col("of_rest")), lambda k: row(k, own, 0)))
    )
    out = out.select("key", "node", F.explode(seats).alias("seat"))
    cell = F.xxhash64("key", "seat.one", "seat.two")
    return stored(out.select(F.pmod(cell, F.lit(buckets)).cast("int").alias("bucket"), "key", cell.alias("cell"), "node", F.col("seat.side").alias("side")))


def across(cells_: DataFrame, joined: DataFrame, nodes: DataFrame, p: int, q: int, all_: bool) -> DataFrame:
    """Pairs (a, b) of one cell and different components (node, root) that may be similar, each told in the cell of the first key they share.

    Unless it is ``all_`` of them, a pair is taken to join its components, and no other one of these is told in that cell: so a cell tells
    fewer pairs than it has members.
    """
    about = nodes.select("node", "n", "signature", "parity").join(joined, "node", "left")
    rows = cells_.join(about.select("node", "n", "signature", "parity", F.coalesce("root", "node").alias("root")), "node")

    def task(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["node"].to_numpy(), table["cell"].to_numpy()))
        table = table.take(pa.array(order))
        cell, node, root, n, side = (table[c].to_numpy() for c in ("cell", "node", "root", "n", "side"))
        key = table["key"].to_numpy().view(np.uint64)
        signature, parity = _signatures(table["signature"]), Parities(table["parity"])
        # components of each cell, as places; equal ones of different cells are apart
        _, label = np.unique(np.stack([cell, root], axis=1), axis=0, return_inverse=True)
        label, top = label.ravel(), np.arange(len(cell))
        found, at, step = [np.zeros((0, 2), np.int64)], np.arange(len(cell)), 1

        def of(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        while len(at):
            # all pairs at one distance in their cells at a time
            at = at[: np.searchsorted(at, len(cell) - step)]
            at = at[cell[at] == cell[at + step]]
            i = at[(label[at] != label[at + step]) & ((side[at] != 1) | (side[at + step] != 1))]
            j = i + step
            i = i[possible(n[i], n[j], signature[i], signature[j], lambda k, i=i, j=j: parity.odd(i[k], parity, j[k]), p, q)]
            i = i[first_shared(signature[i], signature[i + step]) == key[i]]
            if not all_ and len(i):
                new = []
                for x in i.tolist():
                    one, two = of(int(label[x])), of(int(label[x + step]))
                    if one != two:
                        top[max(one, two)] = min(one, two)
                        new.append(x)
                while (top[top] != top).any():
                    top = top[top]
                label, i = top[label], np.array(new, np.int64)
            found.append(np.stack([node[i], node[i + step]], axis=1))
            step += 1
        a, b = np.unique(np.sort(np.concatenate(found), axis=1), axis=0).T
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.groupBy("bucket").applyInArrow(task, "a bigint, b bigint").distinct()


def linked(nodes: DataFrame, texts: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """(node, root) of every node (node, same, code, n, signature, parity) with a link of p / q similarity or more."""
    chains = stored(cells(nodes))
    met = stored(chains.select("a", "b").distinct())
    close = stored(near(met, nodes, p, q))
    ends = close.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("e"), "distance")
    likeliest = ends.groupBy("e.own").agg(F.min(F.struct("distance", "e.other")).alias("to")).select("own", F.col("to.other").alias("other"))
    first = likeliest.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()
    links = confirmed(first, nodes, texts, shingle, p, q)
    second = apart(close.select("a", "b"), stored(roots(links))).join(links, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(second, nodes, texts, shingle, p, q))
    joined = stored(roots(links))
    rest = dealt(chains, stored(apart(met, joined)), joined)
    third = stored(across(rest, joined, nodes, p, q, False)).join(met, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(third, nodes, texts, shingle, p, q))
    # what was taken to be joined and is not, pair by pair
    last = across(rest, stored(roots(links)), nodes, p, q, True).join(met, ["a", "b"], "left_anti").join(third, ["a", "b"], "left_anti")
    return roots(links.unionByName(confirmed(last, nodes, texts, shingle, p, q)))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are what white space separates, A to Z lower-cased; a document's set has its distinct shingles of ``shingle`` words, or
    its whole word sequence where it has fewer words. Documents are linked if the Jaccard similarity of their sets is
    ``similarity`` (0.8 or more) or over; one without words (null, empty) has an empty set and is linked with nothing. component_id is the
    least doc_id reached over links, the document's own included; null where no reached row has one. kept tells
    whether it is the row's doc_id, false for a null id. Rows that share a doc_id are documents of their own. Other columns are ignored.
    Equal sets (by 128 bits of their shingles' 64-bit hashes) meet as one node, so copies cost nothing.
    """
    if similarity < 0.8:
        raise ValueError("signatures are laid out for a similarity of 0.8 or more")
    p, q = Fraction(str(similarity)).as_integer_ratio()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("code", F.xxhash64("text"))
    rows = stored(described(texts, shingle))
    picked = rows.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("code", "n", "signature", "parity")))
    nodes = stored(picked.withColumn("node", F.monotonically_increasing_id()))
    found = linked(nodes, texts, shingle, p, q)
    merged = stored(nodes.select("node", "same", "least").join(found, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root")))
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(join_hot(merged.select("same", "root"), least, "root").select("same", "component_id"))
    some = join_hot(rows.filter("n > 0").select("doc_id", "n", "same"), named, "same").select("doc_id", "n", "component_id")
    out = some.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
