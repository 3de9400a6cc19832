"""Typed tensors as columns: struct<shape: array<int>, dtype: string, data: array<T>>, the numbers in row-major order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nesting(kind: T.DataType) -> tuple[int, T.DataType]:
    """How deep arrays are nested, and what they hold at last."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth, kind


def tensor(x: Column, kind: T.DataType, name: str = "value") -> Column:
    """A nested array as a tensor; one whose parts differ in length is an error by name. Null stays null."""
    depth, inner = nesting(kind)
    if not depth:
        raise TypeError(f"{name} is no array")
    sizes, level, ok = [F.size(x)], x, F.lit(True)
    for _ in range(depth - 1):
        each = F.transform(level, lambda v: F.size(v))
        ok = ok & (F.size(F.array_distinct(each)) <= 1)
        sizes.append(F.coalesce(F.get(each, F.lit(0)), F.lit(0)))
        level = F.flatten(level)
    value = F.struct(F.array(*sizes).alias("shape"), F.lit(inner.simpleString()).alias("dtype"), level.alias("data"))
    return F.when(x.isNull(), None).when(~ok, F.raise_error(F.lit(f"{name} is ragged"))).otherwise(value)


def nested(x: Column, depth: int) -> Column:
    """The nested arrays of a tensor of so many axes."""
    out = x["data"]
    for k in range(depth - 1, 0, -1):
        width = F.get(x["shape"], F.lit(k))
        count = F.aggregate(F.slice(x["shape"], 1, k), F.lit(1), lambda a, b: a * b)
        out = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), _rows(out, width))).otherwise(F.array().cast(T.ArrayType(T.NullType())))
    return out


def _rows(values: Column, width: Column):
    return lambda n: F.slice(values, n * width + 1, width)


def transposed(x: Column, axes: list[int]) -> Column:
    """The tensor with its axes in another order: axis k of the result is axis ``axes[k]``."""
    if sorted(axes) != list(range(len(axes))):
        raise ValueError(f"{axes} is no order of axes")
    shape = [F.get(x["shape"], F.lit(a)) for a in range(len(axes))]
    stride, one = [F.lit(1)] * len(axes), F.lit(1)
    for a in range(len(axes) - 1, -1, -1):
        stride[a], one = one, one * shape[a]
    total = F.aggregate(x["shape"], F.lit(1), lambda a, b: a * b)

    def at(n: Column) -> Column:
        place, rest = F.lit(0), n
        for a in reversed(axes):
            place = place + (rest % F.greatest(shape[a], F.lit(1))) * stride[a]
            rest = F.floor(rest / F.greatest(shape[a], F.lit(1))).cast("int")
        return F.get(x["data"], place)

    data = F.when(total > 0, F.transform(F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1), at)).otherwise(F.slice(x["data"], 1, 0))
    return F.when(x.isNotNull(), F.struct(F.array(*[shape[a] for a in axes]).alias("shape"), x["dtype"].alias("dtype"), data.alias("data")))


def stacked_tensors(rows: DataFrame, key: str, by: str, place: str) -> DataFrame:
    """(``by``, ``key``): the tensors of each group, in order of ``place``, as one with an axis in front.

    Shapes and types are compared by their least and greatest, a partial aggregate; a group in which they differ, or a
    tensor is null, is an error by name.
    """
    x = F.col(key)
    form = F.struct(x["shape"].alias("shape"), x["dtype"].alias("dtype"))
    held = rows.groupBy(by).agg(
        F.min(form).alias("low"), F.max(form).alias("high"), F.count_if(x.isNull()).alias("none"), F.count(F.lit(1)).cast("int").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), x["data"].alias("data")))).alias("parts"),
    )
    bad = F.concat(F.lit(f"{key} cannot be stacked, it has "), F.to_json("low"), F.lit(" and "), F.to_json("high"), F.lit(", nulls: "), F.col("none"))
    whole = F.struct(F.concat(F.array("n"), "low.shape").alias("shape"), F.col("low.dtype").alias("dtype"), F.flatten("parts.data").alias("data"))
    return held.select(by, F.when((F.col("low") == F.col("high")) & (F.col("none") == 0), whole).otherwise(F.raise_error(bad)).alias(key))


def unstacked_tensors(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(``by``, place, ``key``): the parts of each tensor along its first axis."""
    x = F.col(key)
    rest = F.slice(x["shape"], F.lit(2), F.greatest(F.size(x["shape"]) - 1, F.lit(0)))
    width = F.aggregate(rest, F.lit(1), lambda a, b: a * b)
    count = F.get(x["shape"], F.lit(0))
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda n: F.struct(rest.alias("shape"), x["dtype"].alias("dtype"), F.slice(x["data"], n * width + 1, width).alias("data"))))
    return rows.select(by, F.posexplode(parts).alias("place", key)).withColumn("place", F.col("place").cast("bigint"))
