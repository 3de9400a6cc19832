"""Record stores: Parquet with the record layout in the schema's metadata, and one folder for each record."""

from __future__ import annotations

import io
import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.record import Record, records

#: The layout's name, in the metadata of the position column.
FORMAT = "records-1"


def paged(rows: int) -> dict[str, int]:
    """Options of a Parquet writer whose pages hold at most so many rows: a reader skips whole pages that its filters rule out."""
    return {"parquet.page.row.count.limit": rows, "parquet.page.size.row.check.min": min(rows, 100)}


@dataclass(frozen=True)
class ParquetStore:
    """``mode`` is one of Spark's save modes."""

    path: str
    mode: str = "errorifexists"

    def write(self, r: Record) -> None:
        tag = {"record_format": FORMAT, "kinds": json.dumps(r.kinds), "class_names": json.dumps(r.class_names)}
        rows = r.frame.select(r.position.alias("_idx", metadata=tag), *[F.col(c).alias(k) for k, c in r.entries.items()])
        rows.write.mode(self.mode).parquet(self.path)

    def read(self, spark: SparkSession) -> Record:
        frame = spark.read.parquet(self.path)
        tag = frame.schema["_idx"].metadata if "_idx" in frame.columns else {}
        if tag.get("record_format") != FORMAT:
            raise ValueError(f"{self.path} does not hold {FORMAT}")
        out = records(frame, "_idx", json.loads(tag["kinds"]), json.loads(tag["class_names"]))
        return out.with_entries({k: v for k, v in out.entries.items() if k != "_idx"})

    def resume_position(self, spark: SparkSession) -> int:
        """The position after the last that is stored, 0 where nothing is."""
        frame = _there(spark, self.path)
        if frame is None:
            return 0
        top = frame.agg(F.max("_idx")).first()[0]
        return 0 if top is None else top + 1


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class CommittedStore:
    """Records in parts of one range of positions each, with a table of the ranges that are wholly written.

    Every attempt at a range writes a part of its own, named in a table before it begins and in another when it is done.
    Readers see the parts that are done, so an attempt that failed leaves nothing to be read and can be told by name.
    """

    path: str

    def _log(self, spark: SparkSession, name: str, part: str, start: int, stop: int) -> None:
        row = spark.createDataFrame([(part, start, stop)], "part string, start bigint, stop bigint")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _rows(self, spark: SparkSession, name: str) -> list[tuple[str, int, int]]:
        found = _there(spark, f"{self.path}/{name}")
        # a row for each run
        return [] if found is None else sorted(map(tuple, found.select("part", "start", "stop").collect()))

    def committed(self, spark: SparkSession) -> list[tuple[int, int]]:
        """The ranges (start, stop) that are done, joined where they meet, in order."""
        out: list[list[int]] = []
        for start, stop in sorted((a, b) for _, a, b in self._rows(spark, "done")):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return [(a, b) for a, b in out]

    def failed(self, spark: SparkSession) -> list[tuple[str, int, int]]:
        """Attempts (part, start, stop) that began and were not done."""
        done = {part for part, *_ in self._rows(spark, "done")}
        return [row for row in self._rows(spark, "begun") if row[0] not in done]

    def missing(self, spark: SparkSession, start: int, stop: int) -> list[tuple[int, int]]:
        """What of start .. stop is in no committed range, in order."""
        out, at = [], start
        for low, high in self.committed(spark):
            if high <= at or low >= stop:
                continue
            if low > at:
                out.append((at, low))
            at = max(at, high)
        return [*out, (at, stop)] if at < stop else out

    def resume_position(self, spark: SparkSession) -> int:
        """The first position, from 0 on, that is not done."""
        done = self.committed(spark)
        return done[0][1] if done and done[0][0] <= 0 else 0

    def write_range(self, r: Record, start: int, stop: int) -> str:
        """Writes the records of a range as a part and commits it; a range that meets a committed one is refused."""
        spark = r.frame.sparkSession
        if self.missing(spark, start, stop) != [(start, stop)]:
            raise ValueError(f"{start} .. {stop} is empty or holds positions that are committed")
        part = uuid.uuid4().hex
        self._log(spark, "begun", part, start, stop)
        ParquetStore(f"{self.path}/parts/{part}").write(r)
        self._log(spark, "done", part, start, stop)
        return part

    def read(self, spark: SparkSession) -> Record:
        """The records of all parts that are done."""
        parts = [f"{self.path}/parts/{part}" for part, *_ in self._rows(spark, "done")]
        if not parts:
            raise ValueError(f"{self.path} holds no part that is done")
        first = ParquetStore(parts[0]).read(spark)
        frame = spark.read.parquet(*parts)
        out = records(frame, "_idx", first.kinds, first.class_names)
        return out.with_entries({k: v for k, v in out.entries.items() if k != "_idx"})


@dataclass(frozen=True)
class DirectoryStore:
    """A folder NNNNNN for each record: fields.json for plain values, fields.npz for arrays.

    The folder must be one that driver and executors share.
    """

    path: str
    overwrite: bool = False

    def write(self, r: Record) -> None:
        root, overwrite = self.path, self.overwrite
        rows = r.frame.select(r.position.alias("_idx"), *[F.col(c).alias(k) for k, c in r.entries.items()])

        def put(part):
            for row in part:
                values = row.asDict(recursive=True)
                folder = os.path.join(root, f"{values.pop('_idx'):06d}")
                os.makedirs(folder, exist_ok=overwrite)
                arrays = {k: np.array(v) for k, v in values.items() if isinstance(v, list) and all(isinstance(x, (int, float, bool)) for x in v)}
                np.savez(os.path.join(folder, "fields.npz"), **arrays)
                with open(os.path.join(folder, "fields.json"), "w") as out:
                    json.dump({"format": FORMAT, "order": list(values), "plain": {k: v for k, v in values.items() if k not in arrays}}, out)

        rows.foreachPartition(put)

    def read(self, spark: SparkSession, schema: str) -> Record:
        """``schema`` names the entries and their types."""
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
        by_folder = found.groupBy(folder.cast("bigint").alias("_idx")).agg(
            F.max(F.when(F.col("path").endswith("fields.json"), F.col("content"))).alias("json"), F.max(F.when(F.col("path").endswith("fields.npz"), F.col("content"))).alias("npz")
        )
        names = [x.strip().split(" ")[0] for x in _top_level(schema)]

        def load(frames):
            for frame in frames:
                out = []
                for idx, text, arrays in frame.itertuples(index=False):
                    doc = json.loads(bytes(text))
                    if doc.get("format") != FORMAT:
                        raise ValueError("a folder is of another format")
                    held = np.load(io.BytesIO(bytes(arrays)))
                    out.append([idx, *(held[n].tolist() if n in held else doc["plain"].get(n) for n in names)])
                yield type(frame)(out, columns=["_idx", *names])

        out = records(by_folder.mapInPandas(load, f"_idx bigint, {schema}"), "_idx")
        return out.with_entries({k: v for k, v in out.entries.items() if k != "_idx"})


def _top_level(schema: str) -> list[str]:
    """The fields of a schema, commas inside <> aside."""
    depth, parts = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def rows_in_batches(frame: DataFrame, size: int):
    """Rows in order on the driver, a bounded number at once."""
    rows = []
    for row in frame.toLocalIterator(prefetchPartitions=True):
        rows.append(row)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows
