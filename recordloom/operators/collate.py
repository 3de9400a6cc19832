"""Batches: records of one run of positions as one row of arrays, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.plans.record import Record


def collate(r: Record, size: int, number: Column | None = None) -> DataFrame:
    """(batch_id, an array per entry) for each ``size`` positions in order; the last batch may be short.

    Positions are gapless where ``number`` is not given. A batch is the unit that one task holds.
    """
    if size < 1:
        raise ValueError("a batch has records")
    keys = list(r.entries)
    place = number if number is not None else r.position
    row = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(r.order)], *[F.col(r.entries[k]).alias(f"v{i}") for i, k in enumerate(keys)])
    rows = r.frame.select(F.floor(place / size).alias("batch_id"), row.alias("row"))
    batches = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return batches.select("batch_id", *[F.transform("rows", _taker(i)).alias(k) for i, k in enumerate(keys)])


def _taker(i: int):
    return lambda x: x[f"v{i}"]


def stacked(batch: DataFrame, key: str) -> DataFrame:
    """The batches, an error where the arrays of an entry differ in length."""
    sizes = F.array_distinct(F.transform(key, lambda x: F.size(x)))
    bad = F.when(F.size(sizes) > 1, F.raise_error(F.concat(F.lit(f"{key} cannot be stacked, its lengths are "), sizes.cast("string"))))
    return batch.filter(bad.isNull())


def uncollate(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each record of each batch: batch_id, place, entries."""
    rows = batch.select("batch_id", F.posexplode(F.arrays_zip(*keys)).alias("place", "row"))
    return rows.select("batch_id", F.col("place").cast("bigint").alias("place"), *[F.col("row")[k].alias(k) for k in keys])


_COLLATES: dict[str, Callable[[Record, int], DataFrame]] = {"record": collate}


def register_collate(name: str, function: Callable[[Record, int], DataFrame]) -> None:
    """A way to make batches of records, by name; a later one of the same name takes its place."""
    _COLLATES[name] = function


def get_collate(name: str = "record") -> Callable[[Record, int], DataFrame]:
    if name not in _COLLATES:
        raise KeyError(f"no collate {name!r} ({registered_collates()})")
    return _COLLATES[name]


def registered_collates() -> list[str]:
    return sorted(_COLLATES)


def batch_values(batch: DataFrame, key: str) -> DataFrame:
    """(batch_id, values) of one entry; items that carry a ``value`` give that value."""
    kind = batch.schema[key].dataType.elementType
    wrapped = isinstance(kind, T.StructType) and "value" in kind.names
    return batch.select("batch_id", (F.transform(key, lambda x: x["value"]) if wrapped else F.col(key)).alias("values"))


def batch_metadata(batch: DataFrame, exclude: Iterable[str] = ()) -> DataFrame | None:
    """One row per record (batch_id, place, entries) but for the excluded entries; None if none is left.

    Where entries differ in length a batch has as many records as the shortest.
    """
    skip = {"batch_id", *exclude}
    keys = [k for k in batch.columns if k not in skip]
    if not keys:
        return None
    shortest = F.array_min(F.array(*[F.size(k) for k in keys]))
    return uncollate(batch.select("batch_id", *[F.slice(k, F.lit(1), shortest).alias(k) for k in keys]), keys)


def batch_boxes(batch: DataFrame, key: str) -> DataFrame:
    """One row per record (batch_id, place) with those fields of its boxes entry that the entry has."""
    fields = [n for n in ("boxes", "labels", "scores") if n in batch.schema[key].dataType.elementType.names]
    rows = batch.select("batch_id", F.posexplode(key).alias("place", "item"))
    return rows.select("batch_id", F.col("place").cast("bigint").alias("place"), *[F.col("item")[n].alias(n) for n in fields])


def per_record_predictions(batch: DataFrame, key: str) -> DataFrame:
    """One row per record (batch_id, place, prediction) of what a model gave for a whole batch.

    An array has an element per record; a struct with ``predictions`` holds that array; a struct of arrays of one length
    is cut across (other lengths are an error); anything else is the one prediction of its batch.
    """
    kind, x = batch.schema[key].dataType, F.col(key)
    if isinstance(kind, T.StructType) and "predictions" in kind.names:
        x = x["predictions"]
    elif isinstance(kind, T.StructType) and all(isinstance(f.dataType, T.ArrayType) for f in kind.fields):
        sizes = F.array_distinct(F.array(*[F.size(x[n]) for n in kind.names]))
        rows = F.arrays_zip(*[x[n].alias(n) for n in kind.names])
        rows = rows.cast(T.ArrayType(T.StructType([T.StructField(f.name, f.dataType.elementType) for f in kind.fields])))
        x = F.when(F.size(sizes) == 1, rows).otherwise(F.raise_error(F.concat(F.lit(f"{key}: lengths differ: "), sizes.cast("string"))))
    elif not isinstance(kind, T.ArrayType):
        x = F.array(x)
    rows = batch.select("batch_id", F.posexplode(x).alias("place", "prediction"))
    return rows.withColumn("place", F.col("place").cast("bigint"))
