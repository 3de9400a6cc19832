"""Views of record sources: range, concatenation, difference, split, metadata filter, first of a group."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.structure import Where
from recordloom.plans.record import Op, Record, Stream, physical

#: Rows of the smaller side that a join may send to every task.
BROADCAST_ROWS = 100_000


def _moved(r: Record, position: Column) -> Record:
    own = physical("idx")
    return replace(r, frame=r.frame.withColumn(own, position), order=(own, *r.order[1:]))


def range_view(r: Record, start: int | None = None, stop: int | None = None) -> Record:
    """Positions from start to stop, as a slice of a list: negative ones count from the end, all are clamped.

    The source is counted only where a bound is negative.
    """
    n = r.frame.count() if (start or 0) < 0 or (stop is not None and stop < 0) else None

    def bound(x: int) -> int:
        return max(0, x + n) if x < 0 else x

    low = bound(start or 0)
    out = replace(r, frame=r.frame.filter(r.position >= low))
    if stop is not None:
        out = replace(out, frame=out.frame.filter(r.position < bound(stop)))
    return _moved(out, r.position - low)


def concat_view(*sources: Record) -> Record:
    """One source after another; an entry that a source lacks is null there."""
    offset, parts = 0, []
    keys = list(dict.fromkeys(k for s in sources for k in s.entries))
    own, names = physical("idx"), {k: physical(k) for k in keys}
    for k, s in enumerate(sources):
        columns = [F.col(s.entries[key]).alias(names[key]) for key in s.entries]
        parts.append(s.frame.select((s.position + offset).alias(own), *columns))
        offset += s.frame.count() if k < len(sources) - 1 else 0
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part, allowMissingColumns=True)
    return Record(frame, names, (own,), {k: v for s in reversed(sources) for k, v in s.kinds.items()}, next((s.class_names for s in sources if s.class_names), None))


#: Bits of a joint position that a branch's own positions take.
BRANCH_BITS = 48


@dataclass(frozen=True)
class Joint:
    """Streams one after another, each with its own chain of operators.

    Nothing is counted: a record's position is its branch's number above BRANCH_BITS bits of its own position, which orders the branches and
    tells where a record comes from. Entries are matched by name, one that a branch lacks is null there; one whose types
    differ between branches, or whose item types do, is refused by name. Filters and projections go into every branch's scan.
    """

    streams: tuple[Stream, ...]

    def record(self) -> Record:
        if not self.streams:
            raise ValueError("a joint stream has a stream")
        parts = [s.record() for s in self.streams]
        types: dict[str, str] = {}
        kinds: dict[str, str | None] = {}
        for n, r in enumerate(parts):
            for key, column in r.entries.items():
                kind, item = r.frame.schema[column].dataType.simpleString(), r.kinds.get(key)
                if types.setdefault(key, kind) != kind:
                    raise ValueError(f"entry {key!r} is {types[key]} in one stream and {kind} in stream {n}")
                if kinds.setdefault(key, item) != item:
                    raise ValueError(f"entry {key!r} is of item type {kinds[key]} in one stream and {item} in stream {n}")
        own, names = physical("idx"), {k: physical(k) for k in types}
        deep = max(len(r.order) for r in parts) - 1
        places = [physical("place") for _ in range(deep)]
        frame = None
        for n, r in enumerate(parts):
            at = F.lit(n << BRANCH_BITS) + r.position
            inner = [(F.col(r.order[k + 1]) if k + 1 < len(r.order) else F.lit(0)).cast("bigint").alias(p) for k, p in enumerate(places)]
            entries = [(r[k] if k in r.entries else F.lit(None).cast(types[k])).alias(names[k]) for k in types]
            part = r.frame.select(at.alias(own), *inner, *entries)
            frame = part if frame is None else frame.unionByName(part)
        vocabulary = next((r.class_names for r in parts if r.class_names), None)
        return Record(frame, names, (own, *places), {k: v for k, v in kinds.items() if v}, vocabulary)

    def then(self, *ops: Op) -> Stream:
        """A stream of all records, with operators that apply to every branch."""
        return Stream(self.record(), ops)

    def result(self, **how) -> DataFrame:
        return self.record().result(**how)

    def project(self, keys) -> DataFrame:
        """Some entries only; what they do not need is pruned in every branch."""
        out = self.record()
        return out.with_entries({k: out.entries[k] for k in keys if k in out.entries}).result()

    def __len__(self) -> int:
        return sum(len(s) for s in self.streams)


def branch(r: Record) -> Column:
    """Which stream of a joint one a record comes from."""
    return F.shiftright(r.position, BRANCH_BITS).cast("int")


def own_position(r: Record) -> Column:
    """The position that a record of a joint stream has in its own."""
    return r.position.bitwiseAND(F.lit((1 << BRANCH_BITS) - 1))


def normalised(key: Column, compare: str) -> Column:
    """What two keys are compared by: themselves, the base name, or the base name without its last extension."""
    if compare == "value":
        return key
    name = F.regexp_extract(key, r"([^/\\]*)$", 1)
    if compare == "name":
        return name
    if compare == "stem":
        return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    raise ValueError("compare is value, name or stem")


def difference_view(r: Record, remove: Record, key: str, compare: str = "value") -> Record:
    """Records whose key is the key of no record of ``remove``; order and repeated rows stay, null equals null."""
    gone = remove.frame.select(normalised(remove[key], compare).alias("__gone")).distinct()
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return replace(r, frame=r.frame.join(gone, normalised(r[key], compare).eqNullSafe(F.col("__gone")), "left_anti"))


def removed(r: Record, remove: Record, key: str, compare: str = "value") -> int:
    """How many records difference_view() leaves out."""
    return r.frame.count() - difference_view(r, remove, key, compare).frame.count()


def filter_view(r: Record, where: str = "", predicate: Column | None = None) -> Record:
    """Records whose metadata match an expression, and a condition; what is missing is no match."""
    if not where and predicate is None:
        raise ValueError("a filter needs an expression or a predicate")
    out = Where(where)(r) if where else r
    return out.filter(predicate) if predicate is not None else out


def split_counts(n: int, val_fraction: float | None, test_fraction: float | None) -> tuple[int, int, int]:
    """Sizes of train, val and test: held-out ones are rounded half to even and at least 1."""
    for f in (val_fraction, test_fraction):
        if f is not None and not 0 < f < 1:
            raise ValueError("a fraction is between 0 and 1")
    if (val_fraction or 0) + (test_fraction or 0) >= 1:
        raise ValueError("fractions sum to less than 1")
    val, test = (max(1, round(n * f)) if f else 0 for f in (val_fraction, test_fraction))
    return max(0, n - val - test), val, test


#: Bits of a hash, and of those that one count tells apart.
CODE_BITS, STEP_BITS = 60, 12


def boundaries(frame: DataFrame, key: str, sizes) -> tuple[int, list[int]]:
    """How many rows there are, and for each number below of ``sizes(rows)`` the least key with so many rows under it.

    Each turn counts the rows of the open ranges by their next STEP_BITS bits, all ranges in one scan.
    """
    found: list[list[int]] = []  # low, rows under low, rows wanted
    rows, left = 0, CODE_BITS
    while left > 0:
        left -= STEP_BITS
        places = F.shiftright(F.col(key), left)
        open_ = sorted({low >> left + STEP_BITS for low, under, wanted in found if under < wanted})
        if rows and not open_:
            break
        part = frame.filter(F.shiftright(F.col(key), left + STEP_BITS).isin(open_)) if rows else frame
        counts = {r[0]: r[1] for r in part.groupBy(places.alias("place")).count().collect()}
        if not rows:
            rows = sum(counts.values())
            if not rows:
                return 0, [0 for _ in sizes(0)]
            found = [[0, 0, below] for below in sizes(rows)]
        for one in found:
            low, under, wanted = one
            first = low >> left
            for place in sorted(p for p in counts if p >> STEP_BITS == first >> STEP_BITS) if under < wanted else ():
                if under + counts[place] > wanted:
                    one[:] = [place << left, under, wanted]
                    break
                under += counts[place]
                one[:] = [(place + 1) << left, under, wanted]
                if under == wanted:
                    break
    return rows, [low for low, _, _ in found]


#: Rows that share a prefix of the shuffle hash and are ranked by one task.
RANKED = 100_000


def ranked_by(frame: DataFrame, code: str, low: int, high: int, name: str, *order: Column) -> DataFrame:
    """Adds the row's place, from 0, in the order of ``code`` (a hash, all between low and high), then ``order``.

    One count by prefixes of the hash tells how many rows are before each, and rows are ranked among those with their prefix. As many
    prefixes as make some RANKED rows each; the driver sees a number for each.
    """
    n = frame.count()
    bits = max(1, high - low).bit_length()
    shift = max(0, bits - math.ceil(math.log2(max(2, n / RANKED))))
    prefix, before = physical("prefix"), physical("before")
    frame = frame.withColumn(prefix, F.shiftright(F.col(code) - F.lit(low), shift))
    ahead, counts = 0, []
    for place, rows in sorted(map(tuple, frame.groupBy(prefix).count().collect())):
        counts.append((place, ahead))
        ahead += rows
    known = frame.sparkSession.createDataFrame(counts, f"{before}_of bigint, {before} bigint")
    inner = F.row_number().over(Window.partitionBy(prefix).orderBy(code, *order)) - 1
    # a row for each prefix
    joined = frame.withColumn(name, inner).join(F.broadcast(known), F.col(prefix) == F.col(f"{before}_of"))
    return joined.withColumn(name, (F.col(name) + F.col(before)).cast("bigint")).drop(prefix, before, f"{before}_of")


def split_view(r: Record, split: str = "train", val_fraction: float | None = None, test_fraction: float | None = None, seed: int | None = None, rebased: bool = False) -> Record:
    """One part of a seeded shuffle laid out as train, val, test, with exact counts.

    Parts are ranges of a hash of (seed, position); their bounds are found by counting, so no row is
    sorted or moved. Without fractions everything is train. Positions stay those of the source, unless the part is ``rebased``: then its
    records are numbered from 0 in the shuffled order, for which only this part's rows move.
    """
    if split not in ("train", "val", "test"):
        raise ValueError("split is train, val or test")
    if val_fraction is None and test_fraction is None:
        return r if split == "train" else replace(r, frame=r.frame.filter(F.lit(False)))
    if seed is None:
        raise ValueError("a fraction needs a seed")
    code, top = physical("shuffle"), 1 << CODE_BITS
    frame = r.frame.withColumn(code, F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), r.position.cast("string"))), 1, 15), 16, 10).cast("bigint"))

    def ends(n: int) -> list[int]:
        train, val, _ = split_counts(n, val_fraction, test_fraction)
        return [train, train + val]

    _, (first, second) = boundaries(frame.select(code), code, ends)
    second = second if test_fraction else top
    low, high = {"train": (0, first), "val": (first, second), "test": (second, top)}[split]
    part = frame.filter((F.col(code) >= low) & (F.col(code) < high))
    if not rebased:
        return replace(r, frame=part)
    own = physical("idx")
    return replace(r, frame=ranked_by(part, code, low, high, own, *[F.col(o) for o in r.order]), order=(own,))


def first_of_groups(r: Record, by: str, count: int) -> Record:
    """The first ``count`` records of each value of an entry, by position."""
    place = physical("place")
    # a running top-k: Spark keeps at most count rows for each value before the shuffle
    ranked = r.frame.withColumn(place, F.row_number().over(Window.partitionBy(r[by]).orderBy(r.position)))
    return replace(r, frame=ranked.filter(F.col(place) <= count))


def first_value(r: Record, key: str) -> DataFrame:
    """The first value that is not null, in order."""
    return r.frame.filter(r[key].isNotNull()).orderBy(*r.order).limit(1).select(r[key].alias(key))


def at_positions(r: Record, positions: list[int], keys: list[str]) -> DataFrame:
    """Some entries of the records at given positions, in the order given (column ``pos``)."""
    wanted = r.frame.sparkSession.createDataFrame([(k, p) for k, p in enumerate(positions)], "pos bigint, at bigint")
    found = r.frame.join(F.broadcast(wanted) if len(positions) <= BROADCAST_ROWS else wanted, r.position == F.col("at"))
    return found.select("pos", *[r[k].alias(k) for k in keys if k in r.entries])
