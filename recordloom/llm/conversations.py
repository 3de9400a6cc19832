"""Conversation structure repair: cheapest edits by a time-major dynamic programme over many conversations at once.

Turns become tensors with time first: conversations of one length class stand side by side, and a step of
the programme works on one turn of all of them. Going back in time, it stores what every state still costs; going
forward, all conversations trace their edits in step. States are how far the grammar of role initials,
(s?(ua)+)?, has come: nothing yet, s, u, a.

Spark sorts the turns by conversation, and tasks read the sorted rows in batches, so a task holds a batch and one
conversation. A conversation of more than SEGMENT turns is cut into segments that different tasks work on: each tells the
costs from every state at its start to every state at its end, these are joined backwards (min, +), and each segment is
traced from every state it may be entered in, of which the one that fits the segments before is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import checkpointed, join_hot, stored
from .texts import space_table, text_buffers

#: Turns of a conversation that one task works on; longer ones are cut.
SEGMENT = 10_000
#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing, s, u, a. The state after the role that an inserted or re-roled turn gets, by state.
NEXT = np.array([2, 2, 3, 2])
#: The state after a kept turn, by its role initial (s, u, a, any other) and state; -1 where that is not allowed.
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
FAR = 1 << 50
#: What is left to pay after the last turn, by state: turns to insert.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: Kinds of places in a tensor: a role initial (0 to 3), and past the end of a conversation.
PAD = 4

ONE_SPACE = " "


def damaged(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, present) with seeded faults, told by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the turn (its row stays, with present false, to name the conversation), 1 empties the text, 2 removes
    full stops, exclamation and question marks, 3 repeats the turn, 4 makes the role user. A null is one space.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit(ONE_SPACE)) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(own[0], F.lit(":"), own[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(own[3], "[.!?]", "")).otherwise(own[3])
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    found = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(own[2]).alias("role"), text.alias("text"), (fault != 0).alias("present"), times.alias("nth"))
    return found.drop("nth")


def _by_rows(column) -> np.ndarray:
    """A number for each distinct value of a column, null included."""
    return pc.fill_null(column.dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def features(role, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each turn: its role initial (0 to 3), whether its text is blank, and whether it is cut off."""
    data, at = text_buffers(role)
    first = np.full(len(at) - 1, 0, np.uint8)
    some = at[1:] > at[:-1]
    first[some] = data[at[:-1][some]]
    initial = np.select([first == ord(c) for c in "sua"], [0, 1, 2], 3)
    data, at = text_buffers(text)
    seen = np.flatnonzero(space_table()[data])
    last = np.searchsorted(seen, at[1:]) - 1
    place = np.where(last >= 0, seen[np.maximum(last, 0)] if len(seen) else 0, -1)
    blank = place < at[:-1]
    ended = np.zeros(len(blank), bool)
    ended[~blank] = np.isin(data[place[~blank]], list(b".!?"))
    return initial, blank, ~blank & ~ended


def repeated(group: np.ndarray, role, text) -> np.ndarray:
    """Whether an earlier turn of the same group has the same role and text; rows are in order of group."""
    keys = np.stack([_by_rows(text), _by_rows(role), group])
    order = np.lexsort(keys)  # stable
    same = np.zeros(len(group), bool)
    same[order[1:]] = (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)
    return same


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs by state (last axis) where turns may be inserted first: at most three help."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[..., NEXT])
    return cost


def costs(kind: np.ndarray, gone: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What is left to pay before each turn, by state: (turns + 1, conversations, 4).

    ``kind``, ``gone`` (must be deleted) and ``cut`` are time-major tensors (turns, conversations); ``end`` is what is left at the end.
    """
    turns, wide = kind.shape
    left = np.empty((turns + 1, wide, 4), np.int64)
    left[turns] = end
    keep = np.concatenate([KEEP, np.full((1, 4), -1)])
    for t in range(turns - 1, -1, -1):
        after = left[t + 1]
        to = keep[kind[t]]
        stay = np.where(gone[t], FAR, TRUNCATED * cut[t])[:, None]
        best = np.minimum(stay + np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR), stay + REROLE + after[:, NEXT])
        best = _closed(np.minimum(np.minimum(best, DELETE + after), FAR))
        left[t] = np.where((kind[t] == PAD)[:, None], after, best)
    return left


def trace(kind: np.ndarray, gone: np.ndarray, cut: np.ndarray, left: np.ndarray, state: np.ndarray, last: bool):
    """The edits of all conversations in step: (conversation, turn or -1, letter, state after), in order for each, and the states at the end.

    Of edits that cost no more than any, the one with the least letter is taken: D, I, K, R. The letter and the turn
    tell the next state, so that gives the least string.
    """
    turns, wide = kind.shape
    state, made = state.copy(), [np.zeros((4, 0), np.int64)]
    for t in range(turns):
        at = np.flatnonzero(kind[t] != PAD)
        while len(at):
            s, now, after = state[at], left[t, at, state[at]], left[t + 1, at]
            pick = np.arange(len(at))
            to = KEEP[kind[t, at], s]
            stay = np.where(gone[t, at], FAR, TRUNCATED * cut[t, at])
            options = [
                (DELETE + after[pick, s], s, "D"),
                (INSERT + left[t, at, NEXT[s]], NEXT[s], "I"),
                (np.where(to >= 0, stay + after[pick, np.maximum(to, 0)], FAR), to, "K"),
                (stay + REROLE + after[pick, NEXT[s]], NEXT[s], "R"),
            ]
            fits = np.stack([cost == now for cost, _, _ in options])
            which = fits.argmax(axis=0)
            letter = np.array([ord(c) for _, _, c in options])[which]
            state[at] = np.stack([to_ for _, to_, _ in options])[which, pick]
            made.append(np.stack([at, np.where(letter == ord("I"), -1, t), letter, state[at]]))
            at = at[letter == ord("I")]
    while last:
        at = np.flatnonzero(END[state] > 0)
        if not len(at):
            break
        state[at] = NEXT[state[at]]
        made.append(np.stack([at, np.full(len(at), -1), np.full(len(at), ord("I")), state[at]]))
    made = np.concatenate(made, axis=1)
    return made[:, np.argsort(made[0], kind="stable")], state


def tensors(size: np.ndarray, at: np.ndarray, columns: list[np.ndarray], fill: list):
    """Conversations by length class (powers of two): (numbers of the conversations, rows of their first turns, tensors)."""
    classes = np.frexp(np.maximum(size - 1, 0).astype(float))[1]
    for one in np.unique(classes):
        some = np.flatnonzero(classes == one)
        turn = np.arange(size[some].max(initial=0))[:, None]
        inside = turn < size[some]
        row = np.where(inside, at[some] + turn, 0)
        yield some, at[some], [np.where(inside, c[row] if len(c) else f, f) for c, f in zip(columns, fill)]


def _strings(data: np.ndarray, count: np.ndarray) -> pa.Array:
    """Bytes of ASCII cut into strings of the given lengths."""
    at = np.r_[0, np.cumsum(count)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def edited(size: np.ndarray, role, text, flags: tuple, end: np.ndarray, enter: np.ndarray, last: bool):
    """(cost, end state, audit, repaired text, repaired turns) of each run of ``size`` rows, entered in state ``enter``."""
    initial, gone, cut = flags
    at = np.cumsum(size) - size
    cost, out, made = np.zeros(len(size), np.int64), enter.copy(), [np.zeros((4, 0), np.int64)]
    for some, first, (kind, away, open_) in tensors(size, at, [initial, gone, cut], [PAD, False, False]):
        left = costs(kind, away, open_, end)
        cost[some] = left[0, np.arange(len(some)), enter[some]]
        found, out[some] = trace(kind, away, open_, left, enter[some], last)
        rows = np.where(found[1] >= 0, first[found[0]] + found[1], -1)
        made.append(np.stack([some[found[0]], rows, found[2], found[3]]))
    made = np.concatenate(made, axis=1)
    run, row, letter, state = made[:, np.argsort(made[0], kind="stable")]
    audit = _strings(letter, np.bincount(run, minlength=len(size)))
    keeps = letter != ord("D")
    run, row, letter, state = (x[keeps] for x in (run, row, letter, state))
    n = len(role)
    roles = pa.concat_arrays([role.cast(pa.large_string()), pa.array(["user", "assistant"], pa.large_string())])
    texts = pa.concat_arrays([text.cast(pa.large_string()), pa.array([""], pa.large_string())])
    line = pc.binary_join_element_wise(roles.take(pa.array(np.where(letter == ord("K"), row, n + (state == 3)))), texts.take(pa.array(np.where(row >= 0, row, n))), pa.scalar(":", pa.large_string()))
    turns = np.bincount(run, minlength=len(size))
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(turns)].astype(np.int64)), line.cast(pa.large_string()))
    return cost, out, audit, pc.binary_join(lists, pa.scalar("\n", pa.large_string())), turns


def _sums(flag: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group[flag], minlength=n)


def _illegal(initial: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Adjacent turns of a group whose role initials are not su, ua or au."""
    ok = np.zeros((4, 4), bool)
    ok[[0, 1, 2], [1, 2, 1]] = True
    bad = ~ok[initial[:-1], initial[1:]] & (group[:-1] == group[1:])
    return np.bincount(group[1:][bad], minlength=n)


def _gaps(turn, group: np.ndarray, n: int) -> np.ndarray:
    """Numbers that are missing between the least and the greatest turn of each group; rows are in order of group and turn."""
    known = np.flatnonzero(turn.is_valid().to_numpy(zero_copy_only=False))
    value, of = pc.fill_null(turn, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known], group[known]
    out = np.zeros(n, np.int64)
    if len(known):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        fresh = np.r_[True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])]
        end = np.r_[first[1:], len(of)] - 1
        out[of[first]] = value[end] - value[first] + 1 - np.bincount(of[fresh], minlength=n)[of[first]]
    return out


def _plain(column, kind: pa.DataType | None = None) -> pa.Array:
    """One array of a column, strings with long offsets, null strings as one space."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(kind), ONE_SPACE) if kind else column


def repaired(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations (conv_id, turn, role, text, present), in order of conversation, turn, role and text."""
    everyone = _by_rows(_plain(table["conv_id"]))
    begin = np.flatnonzero(np.r_[True, everyone[1:] != everyone[:-1]][: len(everyone)])
    names = table["conv_id"].take(pa.array(begin))
    n = len(begin)
    group = np.repeat(np.arange(n), np.diff(np.r_[begin, len(everyone)]))
    here = pc.fill_null(_plain(table["present"]), False).to_numpy(zero_copy_only=False)
    group, table = group[here], table.filter(pa.array(here))
    role, text = (_plain(table[c], pa.large_string()) for c in ("role", "text"))
    initial, blank, cut = features(role, text)
    again = repeated(group, role, text) & ~blank
    size = np.bincount(group, minlength=n)
    cost, _, audit, whole, _ = edited(size, role, text, (initial, blank | again, cut), END, np.zeros(n, np.int64), True)
    counts = [_gaps(_plain(table["turn"]), group, n), _sums(blank, group, n), _sums(again, group, n), _sums(cut & ~again, group, n), _illegal(initial, group, n), cost]
    return pa.RecordBatch.from_arrays([_plain(names), *[pa.array(c, pa.int64()) for c in counts], audit.cast(pa.string()), whole.cast(pa.string())], names=["conv_id", *RESULTS])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULTS = (*COUNTS, "audit", "repaired")


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired", T.StringType())])


def _whole(rows: DataFrame) -> DataFrame:
    """Results of conversations of bounded length."""

    def tasks(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # where the last conversation of the batch begins, which the next batch may go on with
            number = _by_rows(batch.column(0))
            at = len(number) - int(np.argmin((number == number[-1])[::-1])) if (number != number[-1]).any() else 0
            if not at and held and batch.column(0)[0] == held[-1].column(0)[0]:
                held.append(batch)
                continue
            if at or held:
                done = [*held, batch.slice(0, at)]
                yield repaired(pa.Table.from_batches([b for b in done if b.num_rows]))
            held = [batch.slice(at)]
        if held:
            yield repaired(pa.Table.from_batches(held))

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(tasks, _schema(rows))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in their conversation (from 0): ranges of the order, counted, and places inside; equal rows are dealt by ``salt``."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    ranged = checkpointed(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # a row for each part and long conversation in it
    sizes = ranged.groupBy("part", F.col("conv_id").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("part").alias("in_part"), "of", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = ranged.withColumn("inner", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:])) - 1)
    found = inside.join(before, (F.col("part") == F.col("in_part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    return found.withColumn("place", F.col("before") + F.col("inner")).select("conv_id", "turn", "role", "text", "place")


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Results of conversations that are cut into segments."""
    spaces = [F.coalesce(F.col(c), F.lit(ONE_SPACE)).alias(c) for c in ("role", "text")]
    placed = _numbered(rows.filter("present").select("conv_id", "turn", *spaces))
    parts = [F.col("conv_id").cast("string"), F.col("role"), F.col("text")]
    # what is hashed tells its parts by their lengths; a null id has none
    told = F.concat_ws("|", *[F.coalesce(F.length(p).cast("string"), F.lit("-")) for p in parts[:2]], *parts)
    placed = stored(placed.withColumn("same", F.sha2(told.cast("binary"), 256)).withColumn("segment", F.floor(F.col("place") / segment)))
    first = placed.groupBy("same").agg(F.min("place").alias("first"))
    rows = stored(join_hot(placed, first, "same").withColumn("again", F.col("place") > F.col("first")).drop("same", "first"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    own, key = f"conv_id {kind}, segment bigint", ["conv_id", "segment"]

    def read(table: pa.Table):
        table = table.sort_by("place")
        role, text = (_plain(table[c], pa.large_string()) for c in ("role", "text"))
        initial, blank, cut = features(role, text)
        again = _plain(table["again"]).to_numpy(zero_copy_only=False) & ~blank
        return role, text, initial, blank, again, cut

    def named(table: pa.Table, n: int) -> list:
        return [table[c].take(pa.array([0] * n)).combine_chunks() for c in key]

    def crossed(table: pa.Table) -> pa.Table:
        _, _, initial, blank, again, cut = read(table)
        n, group = len(initial), np.zeros(len(initial), np.int64)
        tensor = [np.repeat(x[:, None], 4, axis=1) for x in (initial, blank | again, cut)]
        # four ends side by side: one state costs nothing, the others are out of reach
        across = costs(*tensor, np.where(np.eye(4, dtype=bool), 0, FAR))[0].T
        numbers = [blank.sum(), again.sum(), (cut & ~again).sum(), _illegal(initial, group, 1)[0], initial[0], initial[n - 1]]
        return pa.Table.from_arrays([*named(table, 1), pa.array([across.ravel().tolist()]), *[pa.array([int(x)]) for x in numbers]], names=names)

    names = ["conv_id", "segment", "across", "blank", "duplicate", "truncated", "illegal", "head", "tail"]
    told = ", ".join(f"{n} bigint" for n in names[3:])
    segments = stored(rows.groupBy(*key).applyInArrow(crossed, f"{own}, across array<bigint>, {told}"))

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment", ignore_index=True)
        left, ends = END, []
        for across in frame["across"][::-1]:
            ends.append(left.tolist())
            left = (np.reshape(across, (4, 4)) + left).min(axis=1)
        ok = {(0, 1), (1, 2), (2, 1)}
        seam = [int((x, y) not in ok) for x, y in zip(frame["tail"], frame["head"][1:])]
        return frame[["conv_id", "segment"]].assign(left=ends[::-1], last=frame["segment"] == frame["segment"].max(), cost=int(left[0]), illegal=frame["illegal"] + np.array([*seam, 0]))

    # a row for each segment: a long conversation has few
    ends = stored(segments.groupBy("conv_id").applyInPandas(joined, f"{own}, left array<bigint>, last boolean, cost bigint, illegal bigint"))

    def traced(table: pa.Table, about: pa.Table) -> pa.Table:
        role, text, initial, blank, again, cut = read(table)
        left, last = np.array(about["left"][0].as_py()), about["last"][0].as_py()
        found = [edited(np.array([len(initial)]), role, text, (initial, blank | again, cut), left, np.array([s]), last) for s in range(4)]
        columns = [pa.array(range(4), pa.int64()), pa.array([int(f[1][0]) for f in found]), *[pa.concat_arrays([f[k] for f in found]).cast(pa.string()) for k in (2, 3)], pa.array([int(f[4][0]) for f in found])]
        return pa.Table.from_arrays([*named(table, 4), *columns], names=["conv_id", "segment", "enter", "leave", "audit", "repaired", "turns"])

    pieces = stored(rows.groupBy(*key).cogroup(ends.groupBy(*key)).applyInArrow(traced, f"{own}, enter bigint, leave bigint, audit string, repaired string, turns bigint"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        leave = {(s, e): x for s, e, x in frame[["segment", "enter", "leave"]].itertuples(index=False)}
        for segment_ in sorted(set(frame["segment"])):
            out.append((segment_, state))
            state = leave[segment_, state]
        return pd.DataFrame(out, columns=["segment", "enter"]).assign(conv_id=frame["conv_id"].iloc[0])[["conv_id", "segment", "enter"]]

    taken = pieces.select(*key, "enter", "leave").groupBy("conv_id").applyInPandas(walk, f"{own}, enter bigint")
    taken = taken.select(F.col("conv_id").alias("of"), F.col("segment").alias("in_segment"), F.col("enter").alias("entered"))
    chosen = pieces.join(taken, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("in_segment")) & (F.col("enter") == F.col("entered")))
    in_order = F.array_sort(F.collect_list(F.struct("segment", "audit", "repaired", "turns")))
    lines = F.transform(F.filter("pieces", lambda p: p["turns"] > 0), lambda p: p["repaired"])
    texts = chosen.groupBy("conv_id").agg(in_order.alias("pieces")).select("conv_id", F.array_join(F.col("pieces.audit"), "").alias("audit"), F.array_join(lines, "\n").alias("repaired"))
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    sums = segments.drop("illegal").join(ends.select(F.col("conv_id").alias("of"), F.col("segment").alias("in_segment"), "cost", "illegal"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("in_segment")))
    sums = sums.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    return beside(beside(texts, turns), sums).select("conv_id", *RESULTS)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired for each conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text and may have ``present``: a row in which that is false or null only names its
    conversation. Other columns are ignored. A null role or text is one space; rows without a conv_id are one conversation.
    Turns are taken by turn (nulls first), then role and text, so equal rows are adjacent. The first fault of each counts: blank (no character but white
    space), duplicate (role and text of an earlier turn), truncated (its last such character is not one of .!?). gaps
    are turn numbers missing between the least and the greatest, illegal are adjacent role initials other than su, ua, au.
    Keeping a turn is free, giving it the role user or assistant costs 2, deleting it 3 (blank and duplicate turns must go), inserting an
    empty turn of user or assistant 2, and each truncated turn that stays 1; what results has the initials
    (s?(ua)+)?. ``audit`` has the initials of the cheapest edits, the ASCII-least string of equally cheap ones, and
    ``repaired`` the lines role:text. A conversation without turns has zeros and empty strings. No rows give no rows.
    Conversations of more than ``segment`` turns are worked on in parts; their result is the same. A conversation's repaired text
    is one value and so at most 2 GB.
    """
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns else F.lit(True)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), present.alias("present"))
    # at most rows / segment ids
    large = rows.filter("present").groupBy("conv_id").count().filter(F.col("count") > segment).select(F.col("conv_id").alias("of"))
    large = checkpointed(large)
    if large.isEmpty():
        return _whole(rows)
    match = F.col("conv_id").eqNullSafe(F.col("of"))
    short = _whole(rows.join(F.broadcast(large), match, "left_anti"))
    return short.unionByName(_long(rows.join(F.broadcast(large), match, "left_semi"), segment))
