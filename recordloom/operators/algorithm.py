"""Operators declared by slots: settings, inputs and outputs as class attributes, and one column function.

    class Gain(Algorithm):
        factor = Param(2.0)
        signal = Input()
        louder = Output()

        def compute(self, signal):
            return {"louder": signal * self.factor}
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.sql import Column

from recordloom.plans.record import Record

_NEEDED = object()


@dataclass(frozen=True)
class Slot:
    """A declared slot: its role (param, input, output), name, default, item type, and the input an output replaces."""

    role: str
    name: str = ""
    default: object = None
    kind: str | None = None
    replaces: str | None = None


def Param(default=_NEEDED) -> Slot:
    return Slot("param", default=default)


def Input(kind: str | None = None) -> Slot:
    """An entry to read; with an item type, the entry must be of that type."""
    return Slot("input", kind=kind)


def Output(kind: str | None = None, replaces: str | None = None) -> Slot:
    """An entry to write, its own or in place of an input."""
    return Slot("output", kind=kind, replaces=replaces)


class Algorithm:
    """Base of declared operators. ``keys`` maps slots to entries of other names; ``compute`` gets a column per input."""

    slots: ClassVar[dict[str, Slot]] = {}

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        own = {k: replace(v, name=k) for k, v in vars(cls).items() if isinstance(v, Slot)}
        for name in own:
            if hasattr(Algorithm, name) or name == "keys":
                raise TypeError(f"{cls.__name__}: a slot cannot be named {name!r}")
        cls.slots = {**cls.slots, **own}
        for slot in cls.of("output"):
            if slot.replaces and slot.replaces not in {s.name for s in cls.of("input")}:
                raise TypeError(f"{cls.__name__}: output {slot.name!r} replaces {slot.replaces!r}, which is no input")

    def __init__(self, keys: Mapping[str, str] | None = None, **settings):
        params = {s.name: s.default for s in self.of("param")}
        unknown = [k for k in settings if k not in params] + [k for k in keys or {} if k not in self.slots or k in params]
        if unknown:
            raise TypeError(f"{type(self).__name__}: no slots {unknown}")
        params |= settings
        unset = [k for k, v in params.items() if v is _NEEDED]
        if unset:
            raise TypeError(f"{type(self).__name__}: settings {unset} are needed")
        self.keys = dict(keys or {})
        for name, value in params.items():
            setattr(self, name, value)

    @classmethod
    def of(cls, role: str) -> list[Slot]:
        return [s for s in cls.slots.values() if s.role == role]

    def entry(self, slot: Slot) -> str:
        """The entry that an input is read from or an output goes to."""
        return self.keys.get(slot.name) or (self.entry(self.slots[slot.replaces]) if slot.replaces else slot.name)

    @property
    def consumes(self) -> dict[str, str]:
        return {self.entry(s): s.kind or "*" for s in self.of("input")}

    @property
    def produces(self) -> dict[str, str]:
        return {self.entry(s): s.kind or "*" for s in self.of("output")}

    def compute(self, **inputs: Column) -> dict[str, Column]:
        raise NotImplementedError

    def run(self, **inputs: Column) -> dict[str, Column]:
        """The outputs for given columns; an error if compute() leaves one out or makes another."""
        made = self.compute(**inputs)
        if set(made) != {s.name for s in self.of("output")}:
            raise ValueError(f"{type(self).__name__}: compute() gives {sorted(made)}, the outputs are {sorted(s.name for s in self.of('output'))}")
        return made

    def __call__(self, r: Record) -> Record:
        for key, kind in self.consumes.items():
            if kind != "*" and r.kinds.get(key) != kind:
                raise ValueError(f"{type(self).__name__}: entry {key!r} is {r.kinds.get(key)}, not {kind}")
        made = self.run(**{s.name: r[self.entry(s)] for s in self.of("input")})
        outs = {s.name: self.entry(s) for s in self.of("output")}
        kinds = {outs[s.name]: s.kind or r.kinds.get(outs[s.name]) for s in self.of("output")}
        return r.put_all({outs[k]: v for k, v in made.items()}, {k: v for k, v in kinds.items() if v})


def algorithm_spec(cls: type[Algorithm]) -> dict[str, list[Slot]]:
    """The declared slots by role."""
    return {role: cls.of(role) for role in ("param", "input", "output")}
