"""Small matters that all operators share: column names, checkpoints, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing, a folder of this machine is set if all of Spark runs on it; on a cluster that is an
    error, as other machines would not see the files.
    """
    _folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as a compressed table in the folder of checkpointed(), and read again."""
    path = f"{_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "recordloom-checkpoints"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir"))
    return context.getCheckpointDir()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken, name = {c.lower() for c in frame.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name as an expression that means this column, dots and back-quotes included."""
    return f"`{name.replace('`', '``')}`"


def own_columns(frame: DataFrame) -> list[str]:
    """The columns of a frame as expressions."""
    return [quoted(c) for c in frame.columns]


def map_arrow(frame: DataFrame, tasks: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow() for tables whose columns may have any names: inside, columns are told by place."""
    inner = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    names = inner.names

    def renamed(batches):
        for batch in tasks(batches):
            yield batch.rename_columns(names)

    plain = frame.toDF(*[f"c{k}" for k in range(len(frame.columns))])
    return plain.mapInArrow(renamed, inner).toDF(*schema.names)


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """``rows`` (stored, read twice) joined with ``lookup``, which has one row for each value of ``key`` that rows have.

    A value that more than 1 / ``parts`` of all rows have would fill one task; there are at most ``parts`` of them,
    so what lookup says of these is broadcast.
    """
    bound = rows.count() / parts
    hot = rows.groupBy(key).count().filter(F.col("count") > F.lit(bound)).select(key)
    known = checkpointed(lookup.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(known.select(key)), key, "left_anti").join(lookup, key)
    return rest.unionByName(rows.join(F.broadcast(known), key))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """The schema with fields of these names at its end, in place of fields of the same name."""
    return T.StructType([*(f for f in schema.fields if f.name not in kinds), *(T.StructField(k, kind) for k, kind in kinds.items())])


def least_hashed(rows: DataFrame, key: str, bound: int, order: str) -> DataFrame:
    """At most ``bound`` rows: those whose hash of ``key`` (added as ``order``) is least, the same ones at every run.

    Of many rows only hashes below a limit that half as many again are expected to meet are sorted, so that
    what tasks send to the driver does not grow with their number.
    """
    rows = rows.withColumn(order, F.xxhash64(F.lit("sample"), F.col(key)))
    n = rows.count()
    if n > 2 * bound:
        rows = rows.filter(F.col(order) < F.lit(int(-(1 << 63) + (1 << 64) * 1.5 * bound / n)).cast("bigint"))
    return rows.orderBy(order, key).limit(bound)
