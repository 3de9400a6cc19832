"""Arrays stored in chunks, so that a slice of an array reads only the chunks it touches.

A store has a table of records (plain entries, and the length of each array) and a table for each array entry with a row
for each chunk, sorted by chunk inside each file and in small pages: a slice becomes a filter on chunk numbers, from the front
or from the end, that skips pages and row groups of the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.plans.record import Record, records
from recordloom.sources.store import FORMAT, paged

#: Rows of a page: the least that a scan skips.
PAGE_ROWS = 64


def _part(x: Column, size: int):
    return lambda n: F.slice(x, n * size + 1, F.lit(size))


def _bound(value: int, length: Column) -> Column:
    """An end of a slice as a place between 0 and the length."""
    at = F.lit(value) if value >= 0 else length + value
    return F.least(F.greatest(at, F.lit(0)), length).cast("int")


@dataclass(frozen=True)
class ArrayStore:
    """``chunk`` elements of the first axis go into one row; ``mode`` is one of Spark's save modes."""

    path: str
    chunk: int = 1024
    mode: str = "errorifexists"

    def write(self, r: Record) -> None:
        """Stores all entries: arrays (of anything) in chunks, other entries as they are. A null array stays null, an empty one empty."""
        kinds = {k: r.frame.schema[c].dataType for k, c in r.entries.items()}
        arrays = [k for k, kind in kinds.items() if isinstance(kind, T.ArrayType)]
        tag = {"record_format": FORMAT, "chunk": self.chunk, "order": json.dumps(list(r.entries)), "arrays": json.dumps({k: kinds[k].simpleString() for k in arrays}), "kinds": json.dumps(r.kinds)}
        light = [F.when(r[k].isNotNull(), F.size(r[k])).alias(k) if k in arrays else r[k].alias(k) for k in r.entries]
        for k in arrays:
            count = F.ceil(F.size(r[k]) / self.chunk).cast("int")
            parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), _part(r[k], self.chunk)))
            rows = r.frame.select(r.position.alias("_idx"), F.size(r[k]).alias("length"), F.posexplode(parts).alias("chunk", "data"))
            rows = rows.withColumn("from_end", F.ceil(F.col("length") / self.chunk).cast("int") - 1 - F.col("chunk"))
            rows = rows.select("_idx", "chunk", "from_end", "length", "data").sortWithinPartitions("chunk", "_idx")
            rows.write.mode(self.mode).options(**paged(PAGE_ROWS)).parquet(f"{self.path}/arrays/{k}")
        # written last: a store without it is none
        r.frame.select(r.position.alias("_idx", metadata=tag), *light).write.mode(self.mode).parquet(f"{self.path}/records")

    def _light(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        frame = spark.read.parquet(f"{self.path}/records")
        tag = frame.schema["_idx"].metadata if "_idx" in frame.columns else {}
        if tag.get("record_format") != FORMAT or "chunk" not in tag:
            raise ValueError(f"{self.path} does not hold {FORMAT} in chunks")
        return frame, tag

    def read_slice(self, spark: SparkSession, key: str, window: slice = slice(None), positions: list[int] | None = None) -> DataFrame:
        """(_idx, value): array[window] of one entry for every record, or for those at some positions; null where the array is.

        As in Python, ends count from the back if they are negative and are clamped; a step is 1 or more.
        """
        light, tag = self._light(spark)
        kinds = json.loads(tag["arrays"])
        if key not in kinds:
            raise KeyError(f"no array {key!r} to slice (arrays: {list(kinds)})")
        start, stop, step = window.start or 0, window.stop, 1 if window.step is None else window.step
        if step < 1:
            raise ValueError("a slice has a step of 1 or more")
        size = tag["chunk"]
        rows = spark.read.parquet(f"{self.path}/arrays/{key}")
        light = light.select("_idx", F.col(f"`{key}`").alias("length"))
        if positions is not None:
            rows, light = rows.filter(F.col("_idx").isin(positions)), light.filter(F.col("_idx").isin(positions))
        # chunks that the slice can touch, told from the front or from the end
        rows = rows.filter(F.col("chunk") >= start // size if start >= 0 else F.col("from_end") <= -(start // size))
        if stop is not None:
            rows = rows.filter(F.col("chunk") <= (stop - 1) // size if stop >= 0 else F.col("from_end") >= (-stop) // size)
        if start >= 0 and stop is not None and 0 <= (stop - 1) // size <= start // size:
            parts = rows.select(F.col("_idx").alias("__of"), F.col("chunk").alias("__first"), F.col("data").alias("__data"))
        else:
            held = rows.groupBy("_idx").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"))
            parts = held.select(F.col("_idx").alias("__of"), F.col("parts.chunk")[0].alias("__first"), F.flatten("parts.data").alias("__data"))
        low, high = _bound(start, F.col("length")), _bound(stop, F.col("length")) if stop is not None else F.col("length")
        value = F.slice("__data", low - F.col("__first") * size + 1, F.greatest(high - low, F.lit(0)))
        if step > 1:
            value = F.filter(value, lambda _, k: k % step == 0)
        empty = F.array().cast(kinds[key])
        found = light.join(parts, F.col("_idx") == F.col("__of"), "left")
        value = F.when(F.col("length").isNull(), None).when((high > low) & F.col("__data").isNotNull(), value).otherwise(empty)
        return found.select("_idx", value.alias("value"))

    def read(self, spark: SparkSession, slices: dict[str, slice] | None = None) -> Record:
        """The records, the arrays named in ``slices`` cut to these; arrays that nothing reads are not read."""
        light, tag = self._light(spark)
        order, arrays, slices = json.loads(tag["order"]), json.loads(tag["arrays"]), slices or {}
        unknown = [k for k in slices if k not in arrays]
        if unknown:
            raise KeyError(f"no array {unknown[0]!r} to slice (arrays: {list(arrays)})")
        frame = light.drop(*arrays)
        for n, k in enumerate(arrays):
            part = self.read_slice(spark, k, slices.get(k, slice(None))).select(F.col("_idx").alias(f"__at{n}"), F.col("value").alias(k))
            frame = frame.join(part, F.col("_idx") == F.col(f"__at{n}"), "left").drop(f"__at{n}")
        out = records(frame.select("_idx", *[F.col(f"`{k}`") for k in order]), "_idx", json.loads(tag["kinds"]))
        return out.with_entries({k: v for k, v in out.entries.items() if k != "_idx"})
