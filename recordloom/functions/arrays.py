"""Kernels over arrays of numbers, as column expressions.

A NaN element is never above or below a bound, as in numpy; Spark alone would order it above everything.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of whole-number element types.
INTEGER_RANGES = {"uint8": (0, 255), "int16": (-(1 << 15), (1 << 15) - 1), "int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1)}
_SPARK_TYPES = {"uint8": "smallint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def amax(a: Column) -> Column:
    """numpy's amax: NaN if there is one, null if there is nothing."""
    return F.array_max(doubles(a))


def amin(a: Column) -> Column:
    a = doubles(a)
    return F.when(F.exists(a, lambda x: F.isnan(x)), F.lit(float("nan"))).otherwise(F.array_min(a))


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def std(a: Column) -> Column:
    """Population standard deviation."""
    squares = F.aggregate(
        doubles(a), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda s, x: F.struct(
            (s["n"] + 1).alias("n"), (s["mean"] + (x - s["mean"]) / (s["n"] + 1)).alias("mean"),
            (s["m2"] + (x - s["mean"]) * (x - s["mean"]) * s["n"] / (s["n"] + 1)).alias("m2"),
        ),
        lambda s: F.sqrt(s["m2"] / s["n"]),
    )
    return F.when(F.size(a) > 0, squares)


def median(a: Column) -> Column:
    """The middle of the sorted elements, or the mean of the two in the middle."""
    s, n = F.array_sort(doubles(a)), F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)


def _bound(value: float | str | None, what: str) -> float | None:
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    value = float(value)
    if math.isnan(value):
        warnings.warn(f"{what} is NaN and is ignored", stacklevel=3)
        return None
    return value


def threshold(a: Column, low: float | Column | None = None, high: float | Column | None = None, low_op: str = ">", high_op: str = "<") -> Column:
    """Array of booleans: within the bounds that are given. Bounds may be columns."""
    if low_op not in (">", ">=") or high_op not in ("<", "<="):
        raise ValueError("low_op is > or >=, high_op is < or <=")
    low = low if isinstance(low, Column) else _bound(low, "low_level")
    high = high if isinstance(high, Column) else _bound(high, "high_level")
    if low is None and high is None:
        raise ValueError("a threshold needs a bound")

    def inside(x: Column) -> Column:
        out = ~F.isnan(x)
        if low is not None:
            bound = low if isinstance(low, Column) else F.lit(low)
            out = out & ((x > bound) if low_op == ">" else (x >= bound))
        if high is not None:
            bound = high if isinstance(high, Column) else F.lit(high)
            out = out & ((x < bound) if high_op == "<" else (x <= bound))
        return out

    return F.transform(doubles(a), inside)


def scale(a: Column, source_min: float, source_max: float, target_min: float = 0.0, target_max: float = 1.0) -> Column:
    """Elements moved from one range to another, not clipped."""
    if source_max == source_min:
        raise ValueError("the source range is empty")
    factor = (float(target_max) - float(target_min)) / (float(source_max) - float(source_min))
    return F.transform(doubles(a), lambda x: (x - F.lit(float(source_min))) * F.lit(factor) + F.lit(float(target_min)))


def to_type(a: Column, dtype: str) -> Column:
    """Elements cast, toward zero for whole numbers; what does not fit is an error."""
    if dtype not in _SPARK_TYPES:
        raise ValueError(f"dtype is one of {sorted(_SPARK_TYPES)}")
    if dtype.startswith("float"):
        return a.cast(f"array<{_SPARK_TYPES[dtype]}>")
    low, high = INTEGER_RANGES[dtype]

    def cast(x: Column) -> Column:
        whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
        bad = F.isnan(x) | (whole < F.lit(low)) | (whole > F.lit(high))
        return F.when(bad, F.raise_error(F.lit(f"an element does not fit {dtype}"))).otherwise(whole).cast(_SPARK_TYPES[dtype])

    return F.transform(doubles(a), cast)


def standardise(a: Column, mean_: float | Sequence[float], std_: float | Sequence[float], max_value: float = 1.0) -> Column:
    """(x - mean * max_value) / (std * max_value); with several means and deviations, one for each channel of interleaved elements."""
    if isinstance(mean_, (int, float)) and isinstance(std_, (int, float)):
        return F.transform(doubles(a), lambda x: (x - F.lit(mean_ * max_value)) / F.lit(std_ * max_value))
    many = max(len(v) for v in (mean_, std_) if not isinstance(v, (int, float)))
    means, stds = ([v] * many if isinstance(v, (int, float)) else list(v) for v in (mean_, std_))
    if len(means) != len(stds):
        raise ValueError("as many means as deviations")

    def of(values: list[float], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v) * max_value) for v in values]), (i % many).cast("int") + 1)

    return F.transform(doubles(a), lambda x, i: (x - of(means, i)) / of(stds, i))


def to_uint8(a: Column, vmin: float | None = None, vmax: float | None = None) -> Column:
    """Elements stretched to 0..255 between ``vmin`` and ``vmax``, the least and the largest finite one where these are not given.

    What is outside is clamped, NaN is the least; zeros where the bounds are equal or the wrong way round.
    """
    a = doubles(a)
    finite = F.filter(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    low = F.lit(float(vmin)) if vmin is not None else F.array_min(finite)
    high = F.lit(float(vmax)) if vmax is not None else F.array_max(finite)

    def one(x: Column) -> Column:
        inside = F.least(F.greatest(F.coalesce(F.nanvl(x, low), low), low), high)
        return F.floor((inside - low) / (high - low) * 255).cast("smallint")

    return F.when(high > low, F.transform(a, one)).otherwise(F.transform(a, lambda x: F.lit(0).cast("smallint")))


def softmax(a: Column) -> Column:
    """Shares of exp(x); the largest element and the sum are found once for each array."""

    def bound(value: Column, make) -> Column:
        return F.get(F.transform(F.array(value), make), F.lit(0))

    def shifted(x: Column) -> Column:
        return bound(F.struct(x.alias("x"), F.array_max(x).alias("top")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"])))

    def shared(x: Column) -> Column:
        return bound(F.struct(x.alias("x"), F.aggregate(x, F.lit(0.0), lambda t, v: t + v).alias("sum")), lambda s: F.transform(s["x"], lambda v: v / s["sum"]))

    return F.when(a.isNotNull(), bound(shifted(doubles(a)), shared))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def top_k(a: Column, k: int) -> Column:
    """The k largest elements with their places: (idx, prob), by value, then place."""
    pairs = F.transform(doubles(a), lambda x, i: F.struct((-x).alias("by"), i.cast("bigint").alias("idx"), x.alias("prob")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["idx"].alias("idx"), p["prob"].alias("prob")))
