"""Bounded training samples and their sparse counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import counts_by_row
from .tables import least_hashed
from .texts import cuts, text_buffers


#: Sort key of samples.
ORDER = "sample_order"


@dataclass
class Counts:
    """Labels of texts, and how often each bucket occurs in them: sparse rows, joined end to end."""

    labels: list
    at: np.ndarray
    bucket: np.ndarray
    number: np.ndarray

    def dense(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Rows of shares: what part of a text's pieces falls in each bucket."""
        out = np.zeros((len(rows), width), np.float32)
        for line, k in zip(out, rows):
            part = slice(self.at[k], self.at[k + 1])
            line[self.bucket[part]] = self.number[part] / max(self.number[part].sum(), 1)
        return out


def sample(labelled: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (text, label, ORDER), the same ones at every run: those whose hash of the id is least.

    Of rows that share an id, those come first whose text has the lesser hash.
    """
    ids = least_hashed(labelled.select("doc_id").distinct(), "doc_id", bound, ORDER)
    # at most bound rows of two longs
    rows = labelled.join(F.broadcast(ids), "doc_id").select("text", label, ORDER)
    return rows.orderBy(ORDER, F.xxhash64("text"), label).limit(bound)


def counted(rows: DataFrame, label: str, sizes: tuple[int, ...], words: bool, bits: int) -> Counts:
    """Labels and bucket counts of a bounded sample, brought to the driver as two flat arrays."""

    def tasks(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            where, number, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
            for i, j in cuts(offsets, 1 << 15):
                for one in counts_by_row(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sizes, words, bits):
                    at = np.flatnonzero(one)
                    where.append(at.astype(np.int32))
                    number.append(one[at].astype(np.float32))
                    size.append(len(at))
            places = pa.array(np.cumsum(size), pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(np.concatenate(x))) for x in (where, number)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["label", ORDER, "bucket", "number"])

    kind = dict(rows.dtypes)[label]
    table = rows.select(F.col("text").cast("string"), label, ORDER).mapInArrow(tasks, f"label {kind}, {ORDER} bigint, bucket array<int>, number array<float>").toArrow()
    table = table.sort_by([(ORDER, "ascending"), ("label", "ascending")]).combine_chunks()
    flat = []
    for name in ("bucket", "number"):
        column = table[name]
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        flat.append(lists.flatten().to_numpy(zero_copy_only=False))
    sizes_ = pa.compute.list_value_length(table["bucket"]).to_numpy()
    return Counts(table["label"].to_pylist(), np.r_[0, np.cumsum(sizes_)].astype(np.int64), *flat)
