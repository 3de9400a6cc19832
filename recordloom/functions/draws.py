"""Random draws that are functions of (seed, position, operator), so that any engine and any partitioning gives the same."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a draw: twelve hexadecimal digits of an md5.
_STEPS = float(1 << 48)


def uniform(seed: int, idx: Column, op: str = "") -> Column:
    """A draw in [0, 1) for each position."""
    key = F.concat(F.lit(f"{seed}/"), idx.cast("string"), F.lit(f"/{op}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(_STEPS)


def between(low: float, high: float, seed: int, idx: Column, op: str = "") -> Column:
    """A draw in [low, high)."""
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * uniform(seed, idx, op)


def choice(values: Sequence, seed: int, idx: Column, op: str = "", weights: Sequence[float] | None = None) -> Column:
    """One of the values, by weight (equal ones if none are given)."""
    if not values:
        raise ValueError("a choice needs values")
    weights = [1.0] * len(values) if weights is None else [float(w) for w in weights]
    if len(weights) != len(values) or min(weights) < 0 or not sum(weights):
        raise ValueError("weights must be as many as the values, not negative, and not all zero")
    draw, total, upto, out = uniform(seed, idx, op), sum(weights), 0.0, None
    for value, weight in zip(values[:-1], weights[:-1]):
        upto += weight
        below = draw < F.lit(upto / total)
        out = F.when(below, F.lit(value)) if out is None else out.when(below, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def grid(start: float, step: float, count: int, seed: int, idx: Column, op: str = "") -> Column:
    """One of ``count`` points from ``start``, ``step`` apart."""
    return F.lit(float(start)) + F.floor(uniform(seed, idx, op) * count).cast("double") * F.lit(float(step))


def grid_points(low: float, high: float, step: float, spacing: str = "linear", count: int = 10, ratio: float = 2.0) -> list[float]:
    """The points of a grid from low to high, each a multiple of ``step``, ascending and once each.

    linear: all multiples; log: ``count`` points even on a log scale; power: ``low`` times each power of ``ratio``;
    the last two are moved to the nearest multiple inside the range.
    """
    if step <= 0 or high < low:
        raise ValueError("a grid needs a step above 0 and low not above high")
    near = 1e-9
    first, last = math.ceil(low / step - near), math.floor(high / step + near)
    if spacing == "linear":
        places = range(first, last + 1)
    elif spacing in ("log", "power"):
        if low <= 0 or (spacing == "power" and ratio <= 1) or (spacing == "log" and count < 1):
            raise ValueError("a log or power grid needs low above 0, a count, and a ratio above 1")
        if spacing == "log":
            values = [low * (high / low) ** (k / max(count - 1, 1)) for k in range(count)]
        else:
            values = [low * ratio**k for k in range(math.floor(math.log(high / low) / math.log(ratio) + near) + 1)]
        places = sorted({min(max(round(v / step), first), last) for v in values}) if first <= last else ()
    else:
        raise ValueError("spacing is linear, log or power")
    return [float(f"{k * step:.12g}") for k in places]


def grid_spaced(low: float, high: float, step: float, seed: int, idx: Column, op: str = "", **spacing) -> Column:
    """One of grid_points(), with equal chances."""
    points = grid_points(low, high, step, **spacing)
    if not points:
        raise ValueError("no point of the grid is in the range")
    place = F.floor(uniform(seed, idx, op) * len(points)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(p) for p in points]), place)


def repeat(make, low: int, high: int, seed: int, idx: Column, op: str = "") -> Column:
    """An array of ``low`` to ``high`` draws: ``make(k)`` builds draw k (a column), with uniform_at() for its numbers."""
    if not 0 <= low <= high:
        raise ValueError("a repeat needs 0 <= low <= high")
    count = span(low, high, seed, idx, f"{op}/count")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(count, F.lit(1).cast("bigint"))), lambda k: make(k - 1))).otherwise(F.slice(F.transform(F.array(F.lit(0).cast("bigint")), make), 1, 0))


def span(low: int, high: int, seed: int, idx: Column, op: str = "") -> Column:
    """A whole number from low to high, both included."""
    return F.lit(low).cast("bigint") + F.floor(uniform(seed, idx, op) * (high - low + 1)).cast("bigint")


def shuffled(seed: int, idx: Column) -> list[Column]:
    """Sort keys of a seeded shuffle."""
    return [F.md5(F.concat(F.lit(f"{seed}/"), idx.cast("string"))), idx]


def first_accepted(make, accept, tries: int = 100, refused: str | None = None) -> Column:
    """The first of up to ``tries`` draws that a condition accepts; null if none is, or an error with the text ``refused``.

    ``make(attempt)`` builds the draw of an attempt (a column), with uniform_at() for its numbers.
    """
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: make(k))
    kept = F.filter(drawn, accept)
    if refused is None:
        return F.get(kept, F.lit(0))
    return F.get(F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit(f"{tries} draws refused: {refused}"))), F.lit(0))


def uniform_at(seed: int, idx: Column, op: str, attempt: Column) -> Column:
    """uniform() of an attempt: its number is part of the operator's name."""
    key = F.concat(F.lit(f"{seed}/"), idx.cast("string"), F.lit(f"/{op}/"), attempt.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(_STEPS)
