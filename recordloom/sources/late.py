"""Metadata filters that spare the payload: light columns are looked at first, wide ones are read only where something is kept.

Two passes over a Parquet table. The first reads the columns of the condition and tells which files hold matches, and
in which ranges of a sorted key. The second reads those files only, with the condition and the ranges pushed into
the scan, so that row groups and pages of the wide columns outside them are skipped. No row moves and nothing is joined by row.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.structure import Where
from recordloom.plans.record import Record, records

#: Equal cells of the key's span that matches are counted in, and ranges that are pushed at most.
CELLS, RANGES = 4096, 64
_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def key_ranges(found: DataFrame, key: str, low: int, high: int, cells: int = CELLS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) that hold every key of ``found``, all between low and high; at most ``most``, apart by the widest gaps.

    The driver sees a count for each of ``cells`` equal parts of the span, however many keys there are.
    """
    width = max(1, -(-(high - low + 1) // cells))
    # whole numbers of any size: a span of bigints may be wider than one
    place = F.expr(f"cast((cast(`{key}` as decimal(38,0)) - {low}) div {width} as bigint)")
    full = sorted(r[0] for r in found.groupBy(place.alias("cell")).count().collect())
    gaps = sorted(range(1, len(full)), key=lambda k: (full[k - 1] - full[k], k))[: most - 1]
    cuts = [0, *sorted(k for k in gaps if full[k] > full[k - 1] + 1), len(full)]
    return [(low + full[a] * width, min(high, low + (full[b - 1] + 1) * width - 1)) for a, b in zip(cuts, cuts[1:]) if a < b]


def _inside(key: str, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | F.col(key).between(low, high)
    return out


def late_filter(spark: SparkSession, path: str, where: str = "", predicate: Column | None = None, key: str | None = None) -> Record:
    """Records of a Parquet table that match an expression, a condition on columns, or both; wide columns are read where matches are.

    ``key`` is an integer column that numbers the records, sorted in each file for the ranges to spare anything; without one records are
    numbered by file and row. What is missing is no match; rows with a null key are kept if they match. The first pass takes place when
    the plan is made; the table must not change before it is run.
    """
    if not where and predicate is None:
        raise ValueError("a filter needs an expression or a predicate")
    frame = spark.read.parquet(path)
    if key is not None and dict(frame.dtypes)[key] not in _WHOLE:
        raise ValueError(f"{key} is no column of whole numbers")

    def matching(rows: DataFrame) -> DataFrame:
        r = records(rows, F.lit(0))
        out = Where(where)(r).frame if where else r.frame
        out = out.filter(predicate) if predicate is not None else out
        return out.drop(*r.order)

    place = F.col("_metadata.file_path")
    marked = frame.withColumn("__file", place)
    if key is None:
        # a row for each file
        rows = marked.withColumn("__row", F.col("_metadata.row_index")).groupBy("__file").agg((F.max("__row") + 1).alias("n")).collect()
        before, ahead = {}, 0
        for name, n in sorted(map(tuple, rows)):
            before[name], ahead = ahead, ahead + n
        kept = sorted(r[0] for r in matching(marked).select("__file").distinct().collect())
    else:
        rows = matching(marked).groupBy("__file").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(F.col(key).isNull()).alias("none")).collect()
        kept = sorted(r["__file"] for r in rows)
    if not kept:
        return records(frame.filter(F.lit(False)), key or F.lit(0))
    reader = spark.read.schema(frame.schema)
    if not unquote(kept[0]).rstrip("/").endswith(f"/{path.rstrip('/').split('/')[-1]}"):
        reader = reader.option("basePath", path)  # a folder, not one file: columns may stand in its names
    pruned = reader.parquet(*[unquote(name) for name in kept])
    if key is None:
        own = pruned.withColumns({"__file": place, "__row": F.col("_metadata.row_index")})
        ahead = spark.createDataFrame([(name, before[name]) for name in kept], "`__of` string, `__before` bigint")
        numbered = matching(own).join(ahead, F.col("__file") == F.col("__of")).withColumn("__idx", F.col("__before") + F.col("__row"))
        out = records(numbered.drop("__file", "__row", "__of", "__before"), "__idx")
        return out.with_entries({k: v for k, v in out.entries.items() if k != "__idx"})
    spans = [r for r in rows if r["low"] is not None]
    if spans and not any(r["none"] for r in rows):
        low, high = min(r["low"] for r in spans), max(r["high"] for r in spans)
        pruned = pruned.filter(_inside(key, key_ranges(matching(frame).select(key), key, low, high)))
    return records(matching(pruned), key)
