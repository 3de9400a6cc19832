"""Array operators of a pipeline. Parameters may be columns, so that other steps can compute them per record."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import arrays as A
from recordloom.plans.record import Record


_REFERENCE = re.compile(r"\{(\w+)\}|\$(\w+)")


def resolved(text: str, r: Record) -> str | Column:
    """A text with {key} replaced by the record's entry, and $NAME by the variable of the driver's environment; what is missing is an error.

    A plain text where no entry is named, else a column of texts.
    """
    parts, at = [], 0
    for m in _REFERENCE.finditer(text):
        parts.append(text[at : m.start()])
        key, name = m.groups()
        if key is not None:
            if key not in r.entries:
                raise KeyError(f"no entry {key!r} for {text!r} (entries: {list(r.entries)})")
            parts.append(r[key].cast("string"))
        elif name in os.environ:
            parts.append(os.environ[name])
        else:
            raise KeyError(f"no environment variable {name!r} for {text!r}")
        at = m.end()
    parts.append(text[at:])
    if all(isinstance(p, str) for p in parts):
        return "".join(parts)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts if not isinstance(p, str) or p])


def number_of(value: float | str | Column | None, r: Record) -> float | Column | None:
    """A parameter as a number: texts are resolved() first, a blank one is none. A text that is no number is an error."""
    if not isinstance(value, str):
        return value
    found = resolved(value, r)
    if isinstance(found, str):
        if not found.strip():
            return None
        try:
            return float(found)
        except ValueError:
            raise ValueError(f"{value!r} is {found!r}, which is no number") from None
    number = found.try_cast("double")
    return F.when(found.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit(f"{value} is "), found, F.lit(", which is no number"))).cast("double"))


@dataclass(frozen=True)
class Threshold:
    """A mask of the values between two levels; a level is a number, a column, or a text with {key} and $NAME in it."""

    field: str
    low_level: float | str | Column | None = None
    high_level: float | str | Column | None = None
    low_op: str = ">"
    high_op: str = "<"
    output: str = "mask"

    def __call__(self, r: Record) -> Record:
        low, high = number_of(self.low_level, r), number_of(self.high_level, r)
        return r.put(self.output, A.threshold(r[self.field], low, high, self.low_op, self.high_op), "Mask")


@dataclass(frozen=True)
class Scale:
    """A linear map of the values of one entry, or of every image where ``field`` is blank."""

    field: str | None
    source_min: float
    source_max: float
    target_min: float = 0.0
    target_max: float = 1.0

    def __call__(self, r: Record) -> Record:
        fields = r.targets(self.field)
        return r.put_all({f: A.scale(r[f], self.source_min, self.source_max, self.target_min, self.target_max) for f in fields}, {f: r.kinds[f] for f in fields if f in r.kinds})


@dataclass(frozen=True)
class ToType:
    """A cast of one entry, or of every image where ``field`` is blank."""

    field: str | None
    dtype: str

    def __call__(self, r: Record) -> Record:
        fields = r.targets(self.field)
        return r.put_all({f: A.to_type(r[f], self.dtype) for f in fields}, {f: r.kinds[f] for f in fields if f in r.kinds})


@dataclass(frozen=True)
class Normalize:
    """One mean and deviation, or one for each channel."""

    field: str
    mean: float | tuple[float, ...]
    std: float | tuple[float, ...]
    max_value: float = 255.0

    def __call__(self, r: Record) -> Record:
        return r.put(self.field, A.standardise(r[self.field], self.mean, self.std, self.max_value), r.kinds.get(self.field))


@dataclass(frozen=True)
class NormalizeToUint8:
    field: str

    def __call__(self, r: Record) -> Record:
        return r.put(self.field, A.to_uint8(r[self.field]), "Image")


@dataclass(frozen=True)
class Pad:
    """Pad a flat row-major image to a larger size, to the right and below; a larger image is an error."""

    field: str
    width: int
    to_width: int
    to_height: int
    value: float = 0.0

    def __call__(self, r: Record) -> Record:
        a = A.doubles(r[self.field])
        height = F.size(a) / self.width
        if self.to_width < self.width:
            raise ValueError("the image is wider than asked for")
        places = F.sequence(F.lit(0), F.lit(self.to_width * self.to_height - 1))

        def one(k: Column) -> Column:
            x, y = k % self.to_width, F.floor(k / self.to_width).cast("int")
            return F.when((x < self.width) & (y < height), F.get(a, y * self.width + x)).otherwise(F.lit(float(self.value)))

        out = F.when(height > self.to_height, F.raise_error(F.lit("the image is higher than asked for"))).otherwise(F.transform(places, one))
        return r.put(self.field, out, "Image")
