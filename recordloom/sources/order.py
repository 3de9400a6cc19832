"""Global order without one task that holds everything."""

from __future__ import annotations

import os
import tempfile
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import draws
from recordloom.plans.record import Record, physical


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is not set, one of this machine, if all of Spark runs on it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or os.path.join(tempfile.gettempdir(), "recordloom-checkpoints")).rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def with_rank(frame: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the row's place in the order of all rows, from 0: rows are dealt to ranges of the order, counted, and numbered inside."""
    part, inner = physical("part"), physical("inner")
    ranged = saved(frame.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    # a row for each partition
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn(inner, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), part).withColumn(name, (F.col("__before") + F.col(inner)).cast("bigint")).drop(part, inner, "__before")


def shuffled(r: Record, seed: int, epoch: int = 0) -> Record:
    """The records in a seeded order, another for each epoch; positions are places in it."""
    own = physical("idx")
    frame = with_rank(r.frame, own, *draws.shuffled(seed, F.concat(F.lit(f"{epoch}/"), r.position.cast("string"))))
    return replace(r, frame=frame, order=(own,))
