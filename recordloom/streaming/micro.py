"""The same plans over a stream of files: stateless operators, and a sink for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recordloom.plans.record import Op, Record, records


def stream_records(spark: SparkSession, path: str, schema, position: str, max_files: int = 100) -> Record:
    """Records of Parquet files as they arrive in a folder. ``position`` names the column that numbers them."""
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return records(frame, position)


def run_stream(source: Record, ops: Sequence[Op], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply operators to every micro-batch and hand it to ``sink(frame, batch number)``, each once; ends when all that is there is read."""
    out = source
    for op in ops:
        out = op(out)
    return out.result().writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
