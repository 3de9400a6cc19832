"""Flows written as plain mappings: step name -> operator, or a mapping of op, from, merge_from and bind."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from recordloom.plans.record import Flow, Record, Step, StepReferenceError

KEYS = ("op", "from", "merge_from", "bind")


def flow_of(source: Record, document: Mapping, output: str = "") -> tuple[Flow, str]:
    """A flow of a mapping's steps, in its order, and the name of its output step (the last, where none is named).

    A step is an operator, None (it hands on what it reads), or a mapping: ``op``, ``from`` (the step that is read), ``merge_from`` (one
    name or several) and ``bind`` (parameter -> "step[entry]"). Everything that cannot hold is refused here, by the step's name:
    other keys, names with a dot, a slash or brackets, references to what is no earlier step, binds without an operator or of
    parameters that it does not have, and an output that is no step.
    """
    if not isinstance(document, Mapping) or not document:
        raise ValueError("a flow is a mapping of steps, at least one")
    steps: list[Step] = []
    earlier = {"source"}

    def known(step: str, key: str, ref: str) -> str:
        if ref not in earlier:
            raise StepReferenceError(f"step {step!r}: {key} names {ref!r}, which is not an earlier step ({sorted(earlier)})")
        return ref

    for name, value in document.items():
        if not isinstance(name, str) or not name or set(name) & set("./[]"):
            raise ValueError(f"bad step name {name!r}: letters without dots, slashes and brackets")
        if name in earlier:
            raise ValueError(f"the step name {name!r} is taken")
        given = dict(value) if isinstance(value, Mapping) else {"op": value}
        strange = [k for k in given if k not in KEYS]
        if strange:
            raise ValueError(f"step {name!r}: unknown keys {strange} (known: {list(KEYS)})")
        op = given.get("op")
        if op is not None and not callable(op):
            raise TypeError(f"step {name!r}: a {type(op).__name__} is no operator")
        reads = given.get("from")
        merges = given.get("merge_from") or ()
        merges = (merges,) if isinstance(merges, str) else tuple(merges)
        bind = given.get("bind") or {}
        if not isinstance(bind, Mapping):
            raise TypeError(f"step {name!r}: bind is a mapping of parameters")
        if bind and op is None:
            raise ValueError(f"step {name!r}: bind needs an operator")
        parameters = {f.name for f in dataclasses.fields(op)} if bind and dataclasses.is_dataclass(op) else None
        for parameter, ref in bind.items():
            step, bracket, entry = str(ref).partition("[")
            if not bracket or not entry.endswith("]") or len(entry) < 2:
                raise ValueError(f"step {name!r}: bind of {parameter!r} is {ref!r}, not step[entry]")
            known(name, f"bind of {parameter!r}", step)
            if parameters is None or parameter not in parameters:
                raise ValueError(f"step {name!r}: {type(op).__name__} has no parameter {parameter!r}")
        steps.append(Step(name, op, known(name, "from", reads) if reads else None, tuple(known(name, "merge_from", m) for m in merges), dict(bind)))
        earlier.add(name)
    output = output or steps[-1].name
    if output not in earlier:
        raise StepReferenceError(f"the output {output!r} is no step ({[s.name for s in steps]})")
    return Flow(source, tuple(steps)), output
