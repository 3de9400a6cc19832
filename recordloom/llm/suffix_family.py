"""The suffix arrays of all batches so far, kept as tables: a logarithmic index family over Spark's catalog.

A level is a table of sparse suffixes (fingerprint of the first bytes, document), range-partitioned and
sorted by fingerprint. A new batch gets its own table, which is merge-joined with every level that is there;
then levels of equal size class are merged, so that there are logarithmically many and a suffix is rewritten
logarithmically often.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .suffix_index import CORE, Stretches, remove_repeated_bytes
from .tables import checkpointed
from .texts import cuts, text_buffers


def suffixes(docs: DataFrame, width: int = 50, core: int = CORE) -> DataFrame:
    """Distinct (key, doc_id) of the suffixes that the texts' windows choose; null texts and ids have none."""

    def tasks(batches):
        for batch in batches:
            doc, null = X.doc_ids(batch.column(0))
            data, offsets = text_buffers(batch.column(1))
            for i, j in cuts(offsets):
                lo, hi = offsets[i], offsets[j]
                found = Stretches(data[lo:hi], offsets[i : j + 1] - lo, width, core)
                known = ~null[found.row + i]
                yield pa.RecordBatch.from_arrays([pa.array(found.key[known].view("int64")), pa.array(doc[found.row[known] + i])], names=["key", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tasks, "key bigint, doc_id bigint").distinct()


class SuffixFamily:
    """Levels are tables ``<name>_<size class>_<id>`` of the session's catalog, in the shared warehouse."""

    def __init__(self, spark: SparkSession, name: str, width: int = 50, core: int = CORE):
        self.spark, self.name, self.width, self.core = spark, name, width, core

    def levels(self) -> dict[int, str]:
        """Size class -> table."""
        found = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_")]
        return {int(t.split("_")[-2]): t for t in found if t.split("_")[-2] != "new"}

    def _put(self, rows: DataFrame) -> None:
        """Write a level; where there is one of its size class, the two are merged and dropped, and so on."""
        spent: list[str] = []
        while True:
            table = f"{self.name}_new_{uuid.uuid4().hex[:12]}"
            rows.repartitionByRange("key").sortWithinPartitions("key", "doc_id").write.saveAsTable(table)
            for old in spent:
                self.spark.sql(f"DROP TABLE {old}")
            size = self.spark.table(table).count().bit_length()
            other = self.levels().get(size)
            if other is None:
                break
            rows, spent = self.spark.table(table).unionByName(self.spark.table(other)), [table, other]
        self.spark.sql(f"ALTER TABLE {table} RENAME TO {self.name}_{size}_{uuid.uuid4().hex[:12]}" if size else f"DROP TABLE {table}")

    def add(self, batch: DataFrame, earlier: DataFrame) -> DataFrame:
        """remove_repeated_bytes() for the documents of ``batch``, held against all earlier batches and itself.

        ``earlier`` has the texts of earlier batches; only those that share a suffix with the batch are read
        again. Ids of later batches are larger. The batch's suffix array then joins the family.
        """
        mine = suffixes(batch, self.width, self.core)
        near = None
        for table in self.levels().values():
            met = self.spark.table(table).join(mine.select("key").distinct(), "key", "left_semi").select("doc_id")
            near = met if near is None else near.unionByName(met)
        docs = batch.select("doc_id", "text")
        if near is not None:
            docs = docs.unionByName(earlier.select("doc_id", "text").join(checkpointed(near.distinct()), "doc_id", "left_semi"))  # levels may be merged before it is read
        found = remove_repeated_bytes(docs, self.width, self.core)
        self._put(mine)
        return found.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")

    def drop(self) -> None:
        for t in self.spark.catalog.listTables():
            if t.name.startswith(f"{self.name}_"):
                self.spark.sql(f"DROP TABLE {t.name}")
