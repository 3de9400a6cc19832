"""Transforms that treat each entry by its item type, with parameters drawn once for a record and shared by all entries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import boxes as B
from recordloom.functions import draws
from recordloom.plans.record import Op, Record
from recordloom.sources.order import saved

#: (transform, item type) -> kernel(value, parameters, record) -> column.
KERNELS: dict[tuple[type, str], Callable[[Column, Column, object], Column]] = {}


def register_kernel(transform: type, kind: str):
    """Make a function the kernel of a transform for an item type; a later one replaces an earlier one."""

    def put(function):
        KERNELS[transform, kind] = function
        return function

    return put


def kernel_for(transform: type, kind: str | None):
    """The kernel of the transform, or of the nearest class it derives from."""
    return next((KERNELS[c, kind] for c in transform.__mro__ if (c, kind) in KERNELS), None)


@dataclass(frozen=True)
class Transform:
    """Base: ``parameters`` makes one column for a record; every entry whose item type has a kernel is replaced.

    ``field`` restricts it to one entry.
    """

    field: str | None = None

    def parameters(self, r: Record) -> Column:
        raise NotImplementedError

    def __call__(self, r: Record) -> Record:
        drawn = r.put("__drawn", self.parameters(r))
        found = {k: kernel_for(type(self), kind) for k, kind in r.kinds.items() if self.field in (None, k)}
        if self.field and not found.get(self.field):
            raise ValueError(f"no kernel of {type(self).__name__} for entry {self.field!r}")
        values = {k: f(r[k], drawn["__drawn"], self) for k, f in found.items() if f}
        out = drawn.put_all(values, {k: r.kinds[k] for k in values})
        return out.with_entries({k: v for k, v in out.entries.items() if k != "__drawn"})


@dataclass(frozen=True)
class Flip(Transform):
    """Mirror images, masks (flat, ``width`` columns) and boxes left to right, all of a record or none."""

    width: int = 8
    probability: float = 0.5
    seed: int = 0

    def parameters(self, r: Record) -> Column:
        return draws.uniform(self.seed, r.position, "flip") < F.lit(float(self.probability))


def _mirrored(value: Column, flip: Column, op: Flip) -> Column:
    w = op.width
    places = F.sequence(F.lit(0), F.size(value) - 1)
    turned = F.transform(places, lambda k: F.get(value, (F.floor(k / w) * w + (w - 1 - k % w)).cast("int")))
    return F.when(flip & (F.size(value) > 0), turned).otherwise(value)


register_kernel(Flip, "Image")(_mirrored)
register_kernel(Flip, "Mask")(_mirrored)


@register_kernel(Flip, "Boxes")
def _mirrored_boxes(value: Column, flip: Column, op: Flip) -> Column:
    w = F.lit(float(op.width))
    return F.when(flip, F.transform(value, lambda b: B.box(w - b["x1"], b["y0"], w - b["x0"], b["y1"]))).otherwise(value)


@dataclass(frozen=True)
class OverKind:
    """A column function over every entry of some item types."""

    function: Callable[[Column], Column]
    kinds: Sequence[str] = ("Image",)
    field: str | None = None

    def __call__(self, r: Record) -> Record:
        keys = [k for k, kind in r.kinds.items() if kind in self.kinds and self.field in (None, k)]
        return r.put_all({k: self.function(r[k]) for k in keys}, {k: r.kinds[k] for k in keys})


@dataclass(frozen=True)
class Tap:
    """Write the records as they are here to a sink, and go on with them; what is before is computed once."""

    sink: object

    def __call__(self, r: Record) -> Record:
        r = replace(r, frame=saved(r.frame))
        self.sink.write(r)
        return r


def as_op(function: Callable[[Record], Record]) -> Op:
    """A function of records as an operator."""
    return function
