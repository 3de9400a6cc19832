"""Operators that hold other operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from recordloom.functions import draws
from recordloom.plans.record import Flow, Op, Record, Step


@dataclass(frozen=True)
class Pipeline:
    ops: Sequence[Op]

    def __call__(self, r: Record) -> Record:
        for op in self.ops:
            r = op(r)
        return r


@dataclass(frozen=True)
class Enable:
    """Operators that a switch turns off."""

    ops: Sequence[Op]
    enabled: bool = True

    def __call__(self, r: Record) -> Record:
        if not isinstance(self.enabled, bool):
            raise TypeError("enabled is True or False")
        if not self.ops:
            raise ValueError("operators are needed")
        return Pipeline(self.ops)(r) if self.enabled else r


@dataclass(frozen=True)
class RandomApply:
    """Apply an operator to the records whose draw is below ``probability``; others keep their values.

    Entries the operator adds are null where it was not applied. It must neither drop nor expand.
    """

    op: Op
    probability: float = 0.5
    seed: int = 0
    name: str = "apply"

    def __call__(self, r: Record) -> Record:
        if not 0 <= self.probability <= 1:
            raise ValueError("probability is from 0 to 1")
        gate = draws.uniform(self.seed, r.position, self.name) < F.lit(float(self.probability))
        out = self.op(r)
        if out.order != r.order:
            raise ValueError("an operator that is applied at random must not expand")
        changed = {k: F.when(gate, out[k]).otherwise(r.frame[r.entries[k]] if k in r.entries else F.lit(None)) for k in out.entries if out.entries[k] != r.entries.get(k)}
        return out.put_all(changed, {k: out.kinds[k] for k in changed if k in out.kinds})


@dataclass(frozen=True)
class ConfigureOp:
    """A side chain computes an entry for each record; it becomes a parameter of the target, which sees the original."""

    ops: Sequence[Op]
    target: Op
    param: str
    source: str

    def __call__(self, r: Record) -> Record:
        side = Pipeline(self.ops)(r)
        return replace(self.target, **{self.param: side[self.source]})(replace(side, entries=r.entries, kinds=r.kinds))


@dataclass(frozen=True)
class Subgraph:
    """A flow as one operator; only the entries of its result leave it."""

    steps: tuple[Step, ...]
    output: str | None = None
    keep: dict = field(default_factory=dict)

    def __call__(self, r: Record) -> Record:
        return Flow(r, self.steps).record(self.output)


@dataclass(frozen=True)
class Parallel:
    """Operators that a pool was to run: Spark's tasks are that pool, so this only holds them together."""

    ops: Sequence[Op]

    def __call__(self, r: Record) -> Record:
        return Pipeline(self.ops)(r)
