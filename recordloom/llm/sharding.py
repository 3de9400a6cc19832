"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id). Each round counts the exact bytes below a few probes
inside every splitter's bracket, over all partitions, and narrows the brackets, until a boundary meets the
tolerance or its bracket holds one text. A group of equal texts that is too large for that is split
by doc_id in the same way. Then the rows move once.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed, free_name, own_columns, partitions

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Bracket:
    """Of a splitter: ``below`` bytes stand under ``low``, ``upto`` under ``high``; the target is between."""

    target: float
    low: int
    high: int
    below: int
    upto: int

    def done(self, tolerance: float) -> bool:
        return self.high - self.low <= 1 or min(self.target - self.below, self.upto - self.target) <= tolerance

    def best(self) -> tuple[int, float]:
        """The end nearer to the target, and how far off it is."""
        off = (self.target - self.below, self.upto - self.target)
        return (self.low, off[0]) if off[0] <= off[1] else (self.high, off[1])

    def probes(self, count: int) -> list[int]:
        """Points that cut the bracket evenly."""
        width = self.high - self.low
        return sorted({self.low + width * k // (count + 1) for k in range(1, count + 1)} - {self.low})

    def narrow(self, points: list[tuple[int, int]]) -> None:
        for point, bytes_ in points:
            if self.low < point < self.high:
                if bytes_ <= self.target:
                    self.low, self.below = max((self.low, self.below), (point, bytes_))
                else:
                    self.high, self.upto = min((self.high, self.upto), (point, bytes_))


def _place(key: Column, points: list[int], at: int = 0) -> Column:
    """How many of the ascending points are not above the key, by halving."""
    if not points:
        return F.lit(at)
    half = len(points) // 2
    return F.when(key < F.lit(points[half]).cast("bigint"), _place(key, points[:half], at)).otherwise(_place(key, points[half + 1 :], at + half + 1))


def _refine(rows: DataFrame, key: str, brackets: list[Bracket], tolerance: float, probes: int, start: int = 0) -> None:
    """Rounds of counting until every bracket is done. ``start``: bytes that stand below all rows."""
    while open_ := [b for b in brackets if not b.done(tolerance)]:
        points = sorted({p for b in open_ for p in b.probes(probes)})
        # as many rows as there are probes
        stats = rows.groupBy(_place(F.col(key), points).alias("place")).agg(F.sum("size"), F.min(key), F.max(key))
        places = {r[0]: r[1:] for r in stats.collect()}
        below, found = start, []
        for k, point in enumerate(points):
            below += places[k][0] if k in places else 0
            found.append((point, below))
        for b in open_:
            b.narrow(found)
            _, least, most = places.get(bisect.bisect_right(points, b.low), (0, b.low, b.high - 1))
            b.low, b.high = max(b.low, least), min(b.high, most + 1)


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 24) -> list[tuple[int, int]]:
    """Boundaries (hash, id) between shards of near equal bytes; rows have bigint ``hash``, ``id`` and ``size``.

    ``tolerance`` is a share of one shard's bytes. Where one text's copies leave no boundary that near,
    a boundary falls between copies; where one row alone is larger, at the nearer side of it.
    """
    total, least, most = rows.agg(F.sum("size"), F.min("hash"), F.max("hash")).first()
    if not total:
        return []
    allowed = tolerance * total / shards
    brackets = [Bracket(total * k / shards, least, most + 1, 0, total) for k in range(1, shards)]
    _refine(rows, "hash", brackets, allowed, probes)
    out = []
    for b in brackets:
        point, off = b.best()
        if off <= allowed:
            out.append((point, _LEAST))
            continue
        group = rows.filter(F.col("hash") == F.lit(b.low).cast("bigint"))
        low, high = group.agg(F.min("id"), F.max("id")).first()
        inner = Bracket(b.target, low, high + 1, b.below, b.upto)
        _refine(group, "id", [inner], allowed, probes, b.below)
        at = inner.best()[0]
        out.append((b.high, _LEAST) if at > high or at > _MOST else (b.low, at))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, probes: int = 24) -> DataFrame:
    """The columns of ``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot`` added.

    Shards hold near equal sums of ``size``; equal texts stay together but where a boundary must cut them.
    Slots number a shard's rows from 0 without gaps. A null text counts as empty, a null doc_id as the
    least; repeated rows are rows of their own. Added columns replace columns of the same name. An empty
    table stays empty.
    """
    docs = docs.drop("size", "shard", "slot")
    hash_, id_, part, number = (free_name(docs, c) for c in ("hash", "id", "part", "number"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"size": (F.octet_length(text) + 1).cast("bigint"), hash_: F.xxhash64(text), id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST).cast("bigint"))})
    keys = checkpointed(keyed.select(F.col(hash_).alias("hash"), F.col(id_).alias("id"), "size"))
    found = splitters(keys, shards, tolerance, probes)

    def sharded(rows: DataFrame, h: str, i: str) -> DataFrame:
        above = [((F.col(h) > F.lit(a).cast("bigint")) | ((F.col(h) == F.lit(a).cast("bigint")) & (F.col(i) >= F.lit(b).cast("bigint")))).cast("int") for a, b in found]
        shard = sum(above[1:], above[0]) if above else F.lit(0)
        return rows.withColumns({"shard": shard.cast("int"), part: F.pmod(F.xxhash64(h, i), F.lit(partitions(rows.sparkSession))).cast("int")})

    counts = sharded(keys, "hash", "id").groupBy("shard", part).agg(F.count(F.lit(1)).alias(number))
    ahead = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", part, F.coalesce(F.sum(number).over(ahead), F.lit(0)).alias("slot"))
    rank = F.row_number().over(Window.partitionBy("shard", part).orderBy(hash_, id_)) - 1
    # the one exchange of whole rows
    placed = sharded(keyed.select(*own_columns(docs), "size", hash_, id_), hash_, id_).withColumn(number, rank).join(counts, ["shard", part])
    return placed.select(*own_columns(docs), "size", "shard", (F.col("slot") + F.col(number)).cast("bigint").alias("slot"))
