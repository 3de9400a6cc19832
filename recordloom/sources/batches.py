"""Stores of fixed-shape batches: a row holds up to ``size`` records, and record k is place k % size of batch k // size.

Appends number their records on from those that are stored. A last batch that is partly filled is written anew, filled up, by the
next append; a small table of appends tells which of them holds which batches, and is written last, so an append that failed
leaves nothing that is read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.tensors import nesting, tensor
from recordloom.plans.record import Record, records
from recordloom.sources.order import with_rank
from recordloom.sources.store import paged


@dataclass(frozen=True)
class BatchStore:
    path: str
    size: int = 32

    def appends(self, spark: SparkSession) -> list:
        """(number, size, first and last batch, records in all, kinds, shapes) of each append, in order."""
        try:
            found = spark.read.parquet(f"{self.path}/appends").orderBy("number").collect()
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        return found

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("a batch has records")

    def _parts(self, appends: list) -> list[tuple[int, int, int]]:
        """(append, first batch, last batch) that count: a later append's batches hide those of an earlier one."""
        out, end = [], None
        for a in reversed(appends):
            last = a["last"] if end is None else min(a["last"], end - 1)
            if last >= a["first"]:
                out.append((a["number"], a["first"], last))
            end = a["first"] if end is None else min(end, a["first"])
        return out[::-1]

    def append(self, r: Record) -> int:
        """Stores records behind those that are there, in their order, and tells how many there are then.

        Entries and types are those of the first append, and arrays of an entry have one shape in the whole store; other
        ones are refused by name before anything is written.
        """
        spark = r.frame.sparkSession
        before = self.appends(spark)
        kinds = {k: r.frame.schema[c].dataType.simpleString() for k, c in r.entries.items()}
        if before and (json.loads(before[0]["kinds"]) != kinds or before[0]["size"] != self.size):
            raise ValueError(f"the store holds batches of {before[0]['size']} of {before[0]['kinds']}, not of {self.size} of {json.dumps(kinds)}")
        keys, total = list(kinds), before[-1]["total"] if before else 0
        arrays = [k for k, c in r.entries.items() if nesting(r.frame.schema[c].dataType)[0]]
        shape = {k: tensor(r[k], r.frame.schema[r.entries[k]].dataType, k)["shape"] for k in arrays}
        ranks = with_rank(r.frame.select(*[F.col(o) for o in r.order], *[r[k].alias(f"v{n}") for n, k in enumerate(keys)], *[shape[k].alias(f"s{n}") for n, k in enumerate(arrays)]), "__rank", *[F.col(o) for o in r.order])
        told = ranks.agg(F.count(F.lit(1)).alias("n"), *[f(f"s{n}").alias(f"{name}{n}") for n in range(len(arrays)) for name, f in (("low", F.min), ("high", F.max))]).first()
        held = json.loads(before[0]["shapes"]) if before else {}
        shapes = {}
        for n, k in enumerate(arrays):
            low, high = told[f"low{n}"], told[f"high{n}"]
            if low != high or (low is not None and held.get(k) not in (None, low)):
                raise ValueError(f"{k} has shapes {low} and {high if low != high else held[k]}: a batch has one")
            shapes[k] = low if low is not None else held.get(k)
        if not told["n"]:
            return total
        rows = ranks.select((F.col("__rank") + total).alias("number"), *[f"v{n}" for n in range(len(keys))])
        if total % self.size:
            kept = self.at(spark, list(range(total - total % self.size, total))).select(F.col("_idx").alias("number"), *[F.col(f"`{k}`").alias(f"v{n}") for n, k in enumerate(keys)])
            rows = rows.unionByName(kept)
        item = F.struct("number", *[f"v{n}" for n in range(len(keys))])
        batches = rows.groupBy(F.floor(F.col("number") / self.size).alias("batch_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        batches = batches.select("batch_id", *[F.col(f"items.v{n}").alias(k) for n, k in enumerate(keys)]).sortWithinPartitions("batch_id")
        number, end = len(before), total + told["n"]
        # a page holds a batch, so that one batch is what a reader of one record reads
        batches.write.mode("overwrite").options(**paged(1)).parquet(f"{self.path}/batches/{number}")
        row = (number, self.size, total // self.size, (end - 1) // self.size, end, json.dumps(kinds), json.dumps(shapes))
        about = spark.createDataFrame([row], "number int, size int, first bigint, last bigint, total bigint, kinds string, shapes string")
        about.coalesce(1).write.mode("append").parquet(f"{self.path}/appends")
        return end

    def __len__(self) -> int:
        found = self.appends(SparkSession.active())
        return found[-1]["total"] if found else 0

    def batches(self, spark: SparkSession) -> DataFrame:
        """(batch_id, an array for each entry), the last batch may be short."""
        found = self.appends(spark)
        if not found:
            raise ValueError(f"{self.path} holds no batches")
        out = None
        for number, first, last in self._parts(found):
            part = spark.read.parquet(f"{self.path}/batches/{number}").filter(F.col("batch_id").between(first, last))
            out = part if out is None else out.unionByName(part)
        return out

    def _unpacked(self, batches: DataFrame) -> DataFrame:
        keys = batches.columns[1:]
        item = F.arrays_zip(*[F.col(f"`{k}`").alias(f"v{n}") for n, k in enumerate(keys)])
        rows = batches.select("batch_id", F.posexplode(item).alias("place", "item"))
        return rows.select((F.col("batch_id") * self.size + F.col("place")).alias("_idx"), *[F.col("item")[f"v{n}"].alias(k) for n, k in enumerate(keys)])

    def read(self, spark: SparkSession) -> Record:
        """All records, numbered from 0."""
        out = records(self._unpacked(self.batches(spark)), "_idx")
        return out.with_entries({k: v for k, v in out.entries.items() if k != "_idx"})

    def at(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """(_idx, entries) of some records; only their batches are read. A number that the store does not have is an error."""
        found = self.appends(spark)
        total = found[-1]["total"] if found else 0
        wrong = [n for n in numbers if not -total <= n < total]
        if wrong or not found:
            raise IndexError(f"no record {wrong[0] if wrong else ''} of {total}")
        numbers = [n % total for n in numbers]
        wanted = {n // self.size for n in numbers}
        out = None
        for number, first, last in self._parts(found):
            here = sorted(b for b in wanted if first <= b <= last)
            if here:
                part = spark.read.parquet(f"{self.path}/batches/{number}").filter(F.col("batch_id").isin(here))
                out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.read.parquet(f"{self.path}/batches/{found[-1]['number']}").filter(F.lit(False))
        return self._unpacked(out).filter(F.col("_idx").isin(numbers))
