"""Running a pipeline into a sink over a range of positions, and looking at single records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recordloom.plans.record import Flow, Op, Record
from recordloom.sources.store import CommittedStore
from recordloom.sources.views import range_view


@dataclass(frozen=True)
class Processor:
    """Source positions start .. stop through operators into a sink; ``start`` may be "resume"."""

    source: Record
    ops: Sequence[Op]
    sink: object
    start: int | str = 0
    stop: int | None = None

    def plan(self, spark: SparkSession) -> dict:
        """What a run would do."""
        start = self.sink.resume_position(spark) if self.start == "resume" else int(self.start)
        return {"start": start, "stop": self.stop, "ops": [type(op).__name__ for op in self.ops], "sink": type(self.sink).__name__}

    def run(self, spark: SparkSession) -> dict:
        plan = self.plan(spark)
        window = self.source.position >= plan["start"]
        if plan["stop"] is not None:
            window &= self.source.position < plan["stop"]
        r = replace(self.source, frame=self.source.frame.filter(window))
        for op in self.ops:
            r = op(r)
        self.sink.write(r)
        return plan

    def run_missing(self, spark: SparkSession, every: int | None = None) -> list[tuple[int, int]]:
        """Runs what of start .. stop no earlier run committed, and tells which ranges that were. The sink is a CommittedStore.

        A range is committed once all of it is written; with ``every``, ranges of at most so many positions one after another, so
        that a failure costs one of them. Without ``stop`` the source's last position ends the run.
        """
        if not isinstance(self.sink, CommittedStore):
            raise TypeError(f"{type(self.sink).__name__} does not tell which ranges it holds")
        start, stop = 0 if self.start == "resume" else int(self.start), self.stop
        if stop is None:
            last = self.source.frame.agg(F.max(self.source.position)).first()[0]
            stop = start if last is None else last + 1
        done = []
        for low, high in self.sink.missing(spark, start, stop):
            for at in range(low, high, every or max(high - low, 1)):
                end = min(high, at + (every or high - low))
                part = self.source.frame.filter((self.source.position >= at) & (self.source.position < end))
                r = replace(self.source, frame=part)
                for op in self.ops:
                    r = op(r)
                self.sink.write_range(r, at, end)
                done.append((at, end))
        return done


def trace(flow: Flow, position: int) -> dict[str, dict | None]:
    """What every step of a flow makes of one record: entries by step, None from a drop on."""
    one = replace(flow.source, frame=flow.source.frame.filter(flow.source.position == position))
    out: dict[str, dict | None] = {}
    for k in range(len(flow.steps)):
        part = Flow(one, flow.steps[: k + 1])
        rows = part.result().take(1)
        out[flow.steps[k].name] = rows[0].asDict(recursive=True) if rows else None
    return out


def head(r: Record, count: int) -> Record:
    return range_view(r, 0, count)
