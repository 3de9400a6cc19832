"""Looking at records without changing them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from recordloom.plans.record import Record


@dataclass(frozen=True)
class PrintRecord:
    """Passes records on unchanged and prints the first ``limit`` of them, one line each.

    It runs a job of its own over these few rows when the plan is made, so it is for looking at small inputs.
    ``values`` off prints names and types only, and runs none.
    """

    label: str = "record"
    limit: int = 3
    values: bool = True
    out: Callable[[str], None] = print

    def __call__(self, r: Record) -> Record:
        types = dict(r.result().dtypes)
        self.out(f"{self.label}: " + ", ".join(f"{k} {r.kinds.get(k, types[k])}" for k in r.entries))
        if self.values:
            for row in r.frame.orderBy(*r.order).select(*[r[k].alias(k) for k in r.entries]).limit(self.limit).collect():
                self.out(f"{self.label}: " + ", ".join(f"{k}={v!r}"[:200] for k, v in row.asDict().items()))
        return r
