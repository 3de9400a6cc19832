"""Quantities such as 2.5 MHz, read from text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes with their factors, the units that may follow, and the units of each kind of quantity.
PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
UNITS = ("Hz", "Sa/s", "S/s", "s")
KINDS = {"rate": ("Hz", "Sa/s", "S/s"), "frequency": ("Hz",), "time": ("s",), "any": UNITS}
_PATTERN = rf"^\s*([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?)\s*([{''.join(PREFIXES)}]?)((?:{'|'.join(UNITS)})?)\s*$"


def parse(text: Column, units: Sequence[str] | None = None) -> Column:
    """The value in the unit itself; a number without a unit counts as it is, null for null.

    An error where the text is no quantity, or is in another unit than ``units`` where these are given.
    """
    number, prefix, own = (F.regexp_extract(text, _PATTERN, k) for k in (1, 2, 3))
    factor = F.lit(1.0)
    for p, f in PREFIXES.items():
        factor = F.when(prefix == p, F.lit(f)).otherwise(factor)
    bad = F.raise_error(F.concat(F.lit("not a quantity: "), text)).cast("double")
    out = F.when(text.isNull(), F.lit(None).cast("double")).when(number == "", bad)
    if units is not None:
        other = F.raise_error(F.concat(F.lit(f"not in {', '.join(units)}: "), text)).cast("double")
        out = out.when(~own.isin("", *units), other)
    return out.otherwise(number.try_cast("double") * factor)


def of_kind(text: Column, kind: str) -> Column:
    """parse() of a rate, a frequency, a time, or any: units of another kind are an error."""
    return parse(text, KINDS[kind])


def unit(text: Column) -> Column:
    """The unit it is written in; null where there is none, or where the text is no quantity."""
    return F.nullif(F.regexp_extract(text, _PATTERN, 3), F.lit(""))
