"""Best-fit packing in bulk-synchronous rounds.

Pieces of one length are interchangeable, and so are sequences with one gap. Spark sorts the pieces
by length and numbers the pieces of each length (a distributed rank: counts per length and part, then
a rank inside the part). The rounds work on runs: a round takes the longest run of pieces that is
left, sweeps the runs of gaps upward from its successor (the smallest gap it fits), gives piece number r
to gap number r of the run, and puts what is left of those gaps back among the gaps. There are at most as many
runs of pieces as lengths, so the rounds see bounded data at any corpus size. Spark then brings every
piece to its place by its length and rank.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed, free_name, partitions, quoted

MATCHES = "length bigint, first bigint, items bigint, sequence bigint, per_sequence bigint, place bigint"


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of runs of pieces with runs of gaps.

    (length, first rank, pieces, first sequence, pieces per sequence, place of the first piece in it).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences
    sizes: list[int] = []  # gaps that are there, ascending
    matches: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, begin: int, end: int) -> None:
        if gap > 0 and end > begin:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((begin, end))

    def fill(gap: int, begin: int, end: int, length: int, rank: int, count: int) -> int:
        """Put pieces into the sequences of one run of gaps; the number of pieces put."""
        each = gap // length
        taken = min(end - begin, -(-count // each))
        items = min(count, taken * each)
        matches.append((length, rank, items, begin, each, capacity - gap))
        whole, rest = divmod(items, each)
        put(gap - each * length, begin, begin + whole)
        if rest:
            put(gap - rest * length, begin + whole, begin + whole + 1)
        put(gap, begin + taken, end)
        return items

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while count:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                new = -(-count // (capacity // length))
                begin, opened = opened, opened + new
                done = fill(capacity, begin, opened, length, rank, count)
            else:
                gap = sizes[at]
                begin, end = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
                done = fill(gap, begin, end, length, rank, count)
            rank, count = rank + done, count - done
    return matches


def best_fit(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (their place, gapless from 0) added.

    ``length`` is from 1 to ``capacity``; anything else, null too, is an error. ``order`` names columns
    that tell equal lengths apart; ties, nulls and repeated rows among them may come in any order. An
    empty table gives an empty table. Columns named like helper columns are kept.
    """
    length, order_ = F.col("length"), [F.col(c) for c in order]
    parts = partitions(pieces.sparkSession)
    part, number, before = (free_name(pieces, x) for x in ("part", "number", "before"))
    bad = F.when(length.isNull() | (length < 1) | (length > capacity), F.raise_error(F.lit("a length is not from 1 to the capacity")))
    pieces = checkpointed(pieces.filter(bad.isNull()).withColumn(part, F.pmod(F.xxhash64(*order_), F.lit(parts))))
    sizes = pieces.groupBy("length", part).agg(F.count(F.lit(1)).alias(number))
    ahead = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(number).over(ahead), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("length", part).orderBy(*order_)) - 1
    ranked = pieces.withColumn(number, rank).join(sizes.drop(number), ["length", part])
    ranked = ranked.withColumn(number, F.col(number) + F.col(before)).drop(part, before)

    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    matches = pieces.sparkSession.createDataFrame(match_runs(counts, capacity), MATCHES)
    # a run makes at most a few matches for each gap size, so the matches are bounded by the capacity
    rows, match = ranked.alias("piece"), F.broadcast(matches).alias("match")
    n = F.col(f"piece.{number}") - F.col("match.first")
    placed = rows.join(match, (F.col("piece.length") == F.col("match.length")) & (n >= 0) & (n < F.col("match.items")))
    each, size = F.col("match.per_sequence"), F.col("match.length")
    return placed.select(
        *[F.col(f"piece.{quoted(c)}") for c in ranked.columns if c != number],
        (F.col("match.sequence") + F.floor(n / each)).cast("bigint").alias("sequence_id"),
        (F.col("match.place") + F.pmod(n, each) * size).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """token_pieces() placed by best_fit(): one row per piece of a document, with its sequence and place."""
    from .tokens import token_pieces

    return best_fit(token_pieces(docs, tokenizer, ranks, pattern, end_id, capacity, with_ids), capacity)
