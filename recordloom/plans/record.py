"""A pipeline of records as one lazy DataFrame plan.

A record is a row; its entries are columns. Operators add columns and never change one in place, so a
fork costs nothing, a merge needs no join, and Catalyst prunes what no output reads.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_numbers = itertools.count()


def physical(key: str) -> str:
    return f"c{next(_numbers)}_{''.join(c if c.isalnum() else '_' for c in key)}"


@dataclass(frozen=True)
class Record:
    """Where the entries of a record are: key -> column of the frame, and the item type of those that have one."""

    frame: DataFrame
    entries: dict[str, str]
    order: tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)
    class_names: tuple[str, ...] | None = None

    @property
    def position(self) -> Column:
        """The stable position of the source record."""
        return F.col(self.order[0])

    def __getitem__(self, key: str) -> Column:
        if key not in self.entries:
            raise KeyError(f"no entry {key!r} (entries: {list(self.entries)})")
        return F.col(self.entries[key])

    def put(self, key: str, value: Column, kind: str | None = None) -> Record:
        return self.put_all({key: value}, {key: kind} if kind else None)

    def put_all(self, values: dict[str, Column], kinds: dict[str, str] | None = None) -> Record:
        names = {k: physical(k) for k in values}
        kept = {k: v for k, v in self.kinds.items() if k not in values}
        return replace(self, frame=self.frame.withColumns({names[k]: v for k, v in values.items()}), entries={**self.entries, **names}, kinds={**kept, **(kinds or {})})

    def with_entries(self, entries: dict[str, str]) -> Record:
        return replace(self, entries=entries, kinds={k: v for k, v in self.kinds.items() if k in entries})

    def filter(self, condition: Column) -> Record:
        """Drop records; a condition that is null drops too."""
        return replace(self, frame=self.frame.filter(condition))

    def expand(self, key: str, values: Column) -> Record:
        """A record for each element; none for an empty or null array. Children keep their order."""
        place, item = physical("place"), physical(key)
        frame = self.frame.select("*", F.posexplode(values).alias(place, item))
        return replace(self, frame=frame, entries={**self.entries, key: item}, order=(*self.order, place))

    def first_of(self, kind: str, required: bool = True) -> str | None:
        """The first entry of an item type."""
        found = next((k for k in self.entries if self.kinds.get(k) == kind), None)
        if found is None and required:
            raise ValueError(f"no entry of type {kind} (entries: {list(self.entries)})")
        return found

    def targets(self, field: str | None) -> list[str]:
        """The entries that an array operator changes: the named one, or every image (a mask's numbers are class ids)."""
        if field:
            if field not in self.entries:
                raise KeyError(f"no entry {field!r} (entries: {list(self.entries)})")
            return [field]
        return [k for k in self.entries if self.kinds.get(k) == "Image"]

    def result(self, ordered: bool = False, position: str | None = None) -> DataFrame:
        """The entries as columns; sorted by position, or with the position as a column, where asked."""
        frame = self.frame.orderBy(*self.order) if ordered else self.frame
        lead = [F.col(self.order[0]).alias(position)] if position else []
        return frame.select(*lead, *[F.col(c).alias(k) for k, c in self.entries.items()])


def records(frame: DataFrame, position: str | Column | None = None, kinds: dict[str, str] | None = None, class_names: Sequence[str] | None = None) -> Record:
    """Records of a frame. ``position`` numbers them: a column, or the file's row order where it is not given."""
    keys = list(frame.columns)
    own = physical("idx")
    if position is None:
        frame = file_positions(frame, own)
    else:
        frame = frame.withColumn(own, (F.col(position) if isinstance(position, str) else position).cast("bigint"))
    return Record(frame, {k: k for k in keys}, (own,), dict(kinds or {}), tuple(class_names) if class_names else None)


def file_positions(frame: DataFrame, name: str) -> DataFrame:
    """Adds the row's place among all rows of a Parquet read: files in order of path, rows in file order.

    One count per file is joined back by path; no row moves.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(frame.inputFiles())
    if len(files) <= 1:
        return frame.withColumn(name, row)
    counts = frame.groupBy(path.alias("__path")).agg((F.max(row) + 1).alias("__rows"))
    # a row for each file
    ahead = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__path", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__before"))
    marked = frame.withColumns({"__own": path, "__row": row})
    return marked.join(before, F.col("__own") == F.col("__path")).withColumn(name, F.col("__before") + F.col("__row")).drop("__own", "__row", "__path", "__before")


Op = Callable[[Record], Record]


@dataclass(frozen=True)
class Stream:
    """Records and the operators that are applied to them, in order; every method gives a new stream."""

    source: Record
    ops: tuple[Op, ...] = ()

    def then(self, *ops: Op) -> Stream:
        return replace(self, ops=(*self.ops, *ops))

    def map(self, key: str, function: Callable[[Column], Column], output: str | None = None) -> Stream:
        """A column function over one entry."""
        return self.then(lambda r: r.put(output or key, function(r[key])))

    def filter(self, predicate: Callable[[Record], Column] | str) -> Stream:
        from recordloom.operators.structure import Where

        return self.then(Where(predicate) if isinstance(predicate, str) else (lambda r: r.filter(predicate(r))))

    def record(self) -> Record:
        out = self.source
        for op in self.ops:
            out = op(out)
        return out

    def result(self, **how) -> DataFrame:
        return self.record().result(**how)

    def project(self, keys: Sequence[str]) -> DataFrame:
        """Some entries only; what they do not need is pruned. Unknown keys are ignored."""
        out = self.record()
        return out.with_entries({k: out.entries[k] for k in keys if k in out.entries}).result()

    def __len__(self) -> int:
        """Records of the source, before operators drop any; an operator that expands has no length."""
        if any(getattr(op, "expands", False) for op in self.ops):
            raise TypeError("a stream that expands records has no length")
        return self.source.frame.count()

    def batch(self, size: int, how: str = "record") -> DataFrame:
        """Batches of ``size`` records in order, the last may be short; ``how`` names a registered collate."""
        from recordloom.operators.collate import get_collate

        return get_collate(how)(self.record(), size)

    def to_sink(self, sink) -> None:
        sink.write(self.record())


@dataclass(frozen=True)
class Step:
    """A named step of a flow: reads an earlier result (the one before, if none is named), overlays the
    entries of others (the last wins), and binds parameters of its operator to values of earlier steps."""

    name: str
    op: Op | None = None
    reads: str | None = None
    merges: tuple[str, ...] = ()
    bind: dict[str, str] = field(default_factory=dict)


class StepReferenceError(ValueError):
    """A step that refers to what is not there yet."""


@dataclass(frozen=True)
class Flow:
    """Steps over one source. All results are columns of one plan; a drop in any step drops the record."""

    source: Record
    steps: tuple[Step, ...]

    def advance(self, done: dict[str, Record], last: str, step: Step) -> Record:
        """What a step makes of the results so far, of which ``last`` is the latest; its frame holds all of them."""
        if not step.name or step.name in done or set(step.name) & set("./[]"):
            raise StepReferenceError(f"bad or repeated step name {step.name!r}")
        for ref in (step.reads, *step.merges, *(v.split("[")[0] for v in step.bind.values())):
            if ref and ref not in done:
                raise StepReferenceError(f"step {step.name!r} refers to {ref!r}, which is not an earlier step ({list(done)})")
        if step.bind and step.op is None:
            raise StepReferenceError(f"step {step.name!r} binds parameters of no operator")
        read = done[step.reads or last]
        entries, kinds = dict(read.entries), dict(read.kinds)
        for other in step.merges:
            entries |= done[other].entries
            kinds |= done[other].kinds
        own = replace(done[last], entries=entries, kinds=kinds)
        op = step.op
        if step.bind:
            op = replace(op, **{p: done[v.split("[")[0]][v.split("[")[1].rstrip("]")] for p, v in step.bind.items()})
        return op(own) if op else own

    def results(self) -> dict[str, Record]:
        done: dict[str, Record] = {"source": self.source}
        last = "source"
        for step in self.steps:
            done[step.name] = self.advance(done, last, step)
            last = step.name
        now = done[last]
        return {k: replace(v, frame=now.frame, order=now.order) for k, v in done.items()}

    def record(self, output: str | None = None) -> Record:
        found = self.results()
        name = output or (self.steps[-1].name if self.steps else "source")
        if name not in found:
            raise StepReferenceError(f"no step {name!r} ({list(found)})")
        return found[name]

    def result(self, output: str | None = None, **how) -> DataFrame:
        return self.record(output).result(**how)
