"""Looking into a flow step by step: stored results of every step, of which a change makes only what follows anew.

A step is known by a fingerprint of its operator's class and parameters, of what it reads and binds, and of all steps
before it. What a step made is written once under that fingerprint; a rerun reads the results of the steps that are the same,
and does again only the changed step and those behind it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import types
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from recordloom.plans.record import Flow, Record, Step, StepReferenceError
from recordloom.sources.order import shared_folder


def described(value) -> str:
    """A parameter as text that differs where its meaning may: functions by their code and what they enclose, plans by what they compute (the files of a table are not looked into)."""
    if isinstance(value, types.FunctionType):
        held = [described(c.cell_contents) for c in value.__closure__ or ()]
        consts = [described(c) if isinstance(c, types.CodeType) else repr(c) for c in value.__code__.co_consts]
        return f"function {value.__module__}.{value.__qualname__} {value.__code__.co_code.hex()} {value.__code__.co_names} {consts} {held} {value.__defaults__}"
    if isinstance(value, types.CodeType):
        return f"code {value.co_code.hex()} {value.co_names} {[described(c) if isinstance(c, types.CodeType) else repr(c) for c in value.co_consts]}"
    if isinstance(value, Column):
        return f"column {value}"
    if isinstance(value, DataFrame):
        return f"frame {value.semanticHash()}"
    if isinstance(value, Record):
        return f"record {described(value.frame)} {list(value.entries)} {value.kinds}"
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return f"{type(value).__module__}.{type(value).__qualname__}({', '.join(f'{f.name}={described(getattr(value, f.name))}' for f in dataclasses.fields(value))})"
    if isinstance(value, dict):
        return f"{{{', '.join(f'{described(k)}: {described(v)}' for k, v in value.items())}}}"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(described, value))}]"
    if hasattr(value, "__dict__") and not isinstance(value, (type, types.ModuleType)):
        return f"{type(value).__module__}.{type(value).__qualname__} {described(vars(value))}"
    return repr(value)


def fingerprint(before: str, step: Step) -> str:
    """The step's own name is part of it, as others refer to it."""
    return hashlib.sha256("\n".join([before, step.name, described(step.op), repr(step.reads), repr(step.merges), described(step.bind)]).encode()).hexdigest()


class Tracer:
    """A flow that is run step by step over its source's records, or over those at some positions.

    Results are tables in ``folder``, one for each fingerprint (a folder of its own in the session's shared one, where none is
    named; one that is named may be used by later tracers of the same source). A refused change leaves the trace as it was.
    """

    def __init__(self, flow: Flow, positions: list[int] | None = None, folder: str | None = None):
        source = flow.source
        if positions is not None:
            source = replace(source, frame=source.frame.filter(source.position.isin(positions)))
        self.flow = replace(flow, source=source)
        self.spark = source.frame.sparkSession
        self.folder = folder or f"{shared_folder(self.spark)}/trace-{uuid.uuid4().hex}"
        self.positions = None if positions is None else sorted(positions)
        self.generation = 0
        self._done: dict[str, Record] = {}
        self._generations: dict[str, int] = {}
        self._paused: str | None = None
        self._computed: list[str] = []

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.flow.steps]

    @property
    def paused_at(self) -> str | None:
        return self._paused

    @property
    def computed(self) -> list[str]:
        """The steps that the last call worked out, rather than read."""
        return list(self._computed)

    def statuses(self) -> dict[str, str]:
        """done, paused or not reached, for each step."""
        return {n: "done" if n in self._done else "paused" if n == self._paused else "not reached" for n in self.names}

    def generations(self) -> dict[str, int | None]:
        """How many reruns there had been when each step was last worked out."""
        return {n: self._generations.get(n) for n in self.names}

    def fingerprints(self) -> dict[str, str]:
        before, out = described([self.flow.source, self.positions]), {}
        for step in self.flow.steps:
            before = out[step.name] = fingerprint(before, step)
        return out

    def _known(self, name: str) -> None:
        if name not in self.names:
            raise StepReferenceError(f"no step {name!r} ({self.names})")

    def _go(self, until: str | None) -> Tracer:
        """Works out what is not done, in order, up to the step named."""
        prints = self.fingerprints()
        self._computed, self._paused, last = [], None, "source"
        for step in self.flow.steps:
            if step.name == until:
                self._paused = until
                break
            if step.name not in self._done:
                done = {"source": self.flow.source, **{n: self._done[n] for n in self.names if n in self._done}}
                made = self.flow.advance(done, last, step)
                path = f"{self.folder}/{prints[step.name]}"
                # columns are named by place: another session's names differ
                keep = made.frame.columns
                rows = made.frame.select(*[f"`{c}`" for c in keep]).toDF(*[f"k{n}" for n in range(len(keep))])
                if not self._complete(path):
                    rows.write.mode("overwrite").parquet(path)
                    self._computed.append(step.name)
                self._generations[step.name] = self.generation
                self._done[step.name] = replace(made, frame=self.spark.read.schema(rows.schema).parquet(path).toDF(*keep))
            last = step.name
        return self

    def _complete(self, path: str) -> bool:
        """Whether a table was written to its end."""
        context = self.spark.sparkContext
        mark = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark)

    def run(self, until: str | None = None) -> Tracer:
        """Runs all steps from the start, or those before ``until``, which is then paused."""
        if until is not None:
            self._known(until)
        self._done, self._generations, self.generation = {}, {}, 0
        return self._go(until)

    def step(self) -> Tracer:
        """Runs the paused step and pauses before the next."""
        if self._paused is None:
            raise RuntimeError("nothing is paused: run(until=...) first")
        at = self.names.index(self._paused) + 1
        return self._go(self.names[at] if at < len(self.names) else None)

    def resume(self) -> Tracer:
        """Runs from the paused step to the end."""
        if self._paused is None:
            raise RuntimeError("nothing is paused: run(until=...) first")
        return self._go(None)

    def rerun_from(self, name: str, **params) -> Tracer:
        """Sets parameters of a step's operator and works out that step and those behind it; earlier ones are read as they are."""
        self._known(name)
        if name not in self._done and name != self._paused:
            raise RuntimeError(f"{name!r} was never reached: run() first")
        at = self.names.index(name)
        step = self.flow.steps[at]
        if params and step.op is None:
            raise TypeError(f"{name!r} has no operator to set parameters of")
        changed = replace(step, op=replace(step.op, **params)) if params else step
        flow = replace(self.flow, steps=(*self.flow.steps[:at], changed, *self.flow.steps[at + 1 :]))
        # the plan of the rest is made before anything is forgotten: what cannot be is refused here
        done, last = {"source": flow.source, **{n: self._done[n] for n in self.names[:at] if n in self._done}}, self.names[at - 1] if at else "source"
        for one in flow.steps[at:]:
            done[one.name] = flow.advance(done, last, one)
            last = one.name
        self.flow, self.generation = flow, self.generation + 1
        for n in self.names[at:]:
            self._done.pop(n, None)
            self._generations.pop(n, None)
        return self._go(None)

    def record(self, name: str) -> Record:
        """What a step made, read from its table."""
        self._known(name)
        if name not in self._done:
            raise RuntimeError(f"{name!r} is {self.statuses()[name]}")
        return self._done[name]

    def result(self, name: str | None = None, **how) -> DataFrame:
        return self.record(name or self.names[-1]).result(**how)

    def value(self, name: str, entry: str, position: int) -> object:
        """An entry of one record as a step made it; None where the step dropped it."""
        r = self.record(name)
        row = r.frame.filter(r.position == position).select(r[entry].alias("value")).take(1)
        return row[0]["value"] if row else None

    def changes(self, name: str) -> dict[str, list[str]]:
        """Entries that a step added, changed and dropped, against what it read; told by columns, without a job."""
        at = self.names.index(name)
        step = self.flow.steps[at]
        before = step.reads or (self.names[at - 1] if at else "source")
        old = (self.flow.source if before == "source" else self.record(before)).entries
        new = self.record(name).entries
        return {"added": [k for k in new if k not in old], "changed": [k for k in new if k in old and new[k] != old[k]], "dropped": [k for k in old if k not in new]}
