"""Operators on the entries of a record."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import draws, expressions
from recordloom.plans.record import Record


@dataclass(frozen=True)
class RenameField:
    """Rename an entry in place; an entry of the new name is replaced, wherever it stands."""

    src: str
    dst: str

    def __call__(self, r: Record) -> Record:
        if not self.src or not self.dst:
            raise ValueError("src and dst are needed")
        r[self.src]
        entries = {self.dst if k == self.src else k: v for k, v in r.entries.items() if k != self.dst or self.src == self.dst}
        kind = {self.dst: r.kinds[self.src]} if self.src in r.kinds else {}
        out = r.with_entries(entries)
        return Record(out.frame, out.entries, out.order, {**{k: v for k, v in out.kinds.items() if k != self.dst}, **kind}, out.class_names)


@dataclass(frozen=True)
class DropField:
    key: str
    missing_ok: bool = False

    def __call__(self, r: Record) -> Record:
        if not self.missing_ok:
            r[self.key]
        return r.with_entries({k: v for k, v in r.entries.items() if k != self.key})


@dataclass(frozen=True)
class CopyField:
    src: str
    dst: str

    def __call__(self, r: Record) -> Record:
        return r.put(self.dst, r[self.src], r.kinds.get(self.src))


@dataclass(frozen=True)
class SelectFields:
    """Keep the named entries only, in the given order."""

    keys: Sequence[str]

    def __call__(self, r: Record) -> Record:
        if not self.keys:
            raise ValueError("keys are needed")
        if missing := [k for k in self.keys if k not in r.entries]:
            raise KeyError(f"unknown keys {missing} (entries: {list(r.entries)})")
        return r.with_entries({k: r.entries[k] for k in self.keys})


@dataclass(frozen=True)
class PutField:
    """A label with a constant, or computed, value."""

    key: str
    value: object

    def __call__(self, r: Record) -> Record:
        if self.value is None:
            raise ValueError("a value is needed")
        value = self.value(r) if callable(self.value) else self.value
        return r.put(self.key, F.struct((value if isinstance(value, Column) else F.lit(value)).alias("value")), "Label")


@dataclass(frozen=True)
class RandomNumber:
    """A uniform draw for each record, from (seed, position, name)."""

    key: str
    low: float = 0.0
    high: float = 1.0
    seed: int | None = 0
    name: str = "number"

    def __call__(self, r: Record) -> Record:
        if self.seed is None:
            return r.put(self.key, F.lit(float(self.low)) + F.rand() * F.lit(float(self.high) - float(self.low)))
        return r.put(self.key, draws.between(self.low, self.high, self.seed, r.position, self.name))


@dataclass(frozen=True)
class Where:
    """Keep records for which an expression over entries (``x``, ``x.attribute``) is true; what is missing is no match."""

    text: str

    def __call__(self, r: Record) -> Record:
        schema = {k: r.frame.schema[c].dataType for k, c in r.entries.items()}

        def name(key: str) -> Column:
            if key not in r.entries:
                return F.lit(None)
            return r[key]["value"] if isinstance(schema[key], T.StructType) and "value" in schema[key].names else r[key]

        def attribute(key: str, attr: str) -> Column:
            kind = schema.get(key)
            if isinstance(kind, T.StructType) and attr in kind.names:
                return r[key][attr]
            return r[key] if key in schema and attr == "value" else F.lit(None)

        return r.filter(expressions.translate(self.text, name, attribute))


@dataclass(frozen=True)
class Formula:
    """Replace an entry by a formula of it (named ``var``) and of other entries."""

    text: str
    key: str
    var: str = "x"
    output: str | None = None

    def __call__(self, r: Record) -> Record:
        value = expressions.translate(self.text, lambda k: r[self.key] if k == self.var else r[k])
        return r.put(self.output or self.key, value, r.kinds.get(self.key))


@dataclass(frozen=True)
class MapOp:
    """A function of columns."""

    function: Callable[..., Column]
    keys: Sequence[str]
    output: str

    def __call__(self, r: Record) -> Record:
        return r.put(self.output, self.function(*[r[k] for k in self.keys]))


@dataclass(frozen=True)
class Expand:
    """One record for each element of an array entry."""

    key: str
    values: Callable[[Record], Column]
    expands: ClassVar[bool] = True

    def __call__(self, r: Record) -> Record:
        return r.expand(self.key, self.values(r))


@dataclass(frozen=True)
class WiredEntries:
    """Rename several entries at once; swaps are allowed."""

    wires: dict[str, str]

    def __call__(self, r: Record) -> Record:
        for src in self.wires.values():
            r[src]
        taken = set(self.wires.values()) | set(self.wires)
        return r.with_entries({**{k: v for k, v in r.entries.items() if k not in taken}, **{dst: r.entries[src] for dst, src in self.wires.items()}})
