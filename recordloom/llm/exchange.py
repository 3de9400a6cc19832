"""Exchange of fingerprints between texts that may share passages.

A fingerprint is a 64-bit hash with the document it stands in. Tasks sort their fingerprints, settle
what one task can settle by itself, and send one row of packed arrays per destination bucket instead
of one row per fingerprint. A fingerprint that is very common leaves a task at most once (or twice,
where two contexts matter), so a hot passage costs its bucket no more rows than there are tasks.
What one task settles is compared by a second hash of the same bytes (``val``) too, so equal means equal in 96 bits there, or
128 for whole texts; what comes back to a document is told by 64 bits of (document, hash).

Rows: ``bucket int, tag int, doc binary, key binary, val binary``. Buckets below ``n`` are chosen by the
key; a row for a document goes to ``n`` + the document's bucket while it only passes through a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import partitions
from .texts import mix, text_buffers, xxh64_long

ROWS = "bucket int, tag int, doc binary, key binary, val binary"
NAMES = ("bucket", "tag", "doc", "key", "val")
ARROW = pa.schema([("bucket", pa.int32()), ("tag", pa.int32()), ("doc", pa.binary()), ("key", pa.binary()), ("val", pa.binary())])
#: Buckets for each shuffle partition. Rows of packed arrays number up to buckets squared, so there are no more than tasks.
BUCKETS_PER_PARTITION = 1
#: Bits of a second hash that are sent: the planes of the others hold zeros.
SECOND = np.uint64(0xFFFFFFFF00000000)
#: Text that one task gathers before it sends its fingerprints, in bytes.
SEND_BYTES = 48 << 20


def packed(values: np.ndarray) -> bytes:
    """Values as byte planes: the planes that hold only zeros then compress to nothing."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys as differences to the one before: small, and so mostly zero planes, where they are sorted."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the keys: a sorted run of keys is a sorted run of buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document, as bucketed() computes it in Spark."""
    return np.mod(xxh64_long(docs), n)


def bucketed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text and the document's bucket; texts without a doc_id take no part in the exchange and may stand in any."""
    doc, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    dealt = F.when(doc.isNull(), F.xxhash64(text, F.spark_partition_id())).otherwise(F.xxhash64(doc))
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.pmod(dealt, F.lit(n)).cast("int").alias("bucket"))


def default_buckets(docs: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * partitions(docs.sparkSession)


def spread(tag: int, bucket: np.ndarray, doc: np.ndarray, key: np.ndarray, val: np.ndarray | None = None) -> list[tuple]:
    """One row for each bucket that gets something."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, doc, key = bucket[order], doc[order], key[order]
    val = val[order] if val is not None else None
    at = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    return [(int(bucket[i]), tag, packed(doc[i:j]), packed_keys(key[i:j]), packed(val[i:j]) if val is not None else None) for i, j in zip(at[:-1], at[1:])]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def as_pandas(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(NAMES))


def gathered(frame, tag: int, with_val: bool = False) -> tuple:
    """The arrays of all rows of one tag, joined."""
    rows = frame[frame["tag"] == tag]
    doc = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, np.int64) for x in rows["doc"])])
    key = np.concatenate([np.zeros(0, np.uint64), *map(unpacked_keys, rows["key"])])
    if not with_val:
        return doc, key
    return doc, key, np.concatenate([np.zeros(0, np.uint64), *(unpacked(x, np.uint64) for x in rows["val"])])


def distinct_pairs(key: np.ndarray, doc: np.ndarray, val: np.ndarray | None = None):
    """Distinct (key, doc) in order, with for each pair the smallest doc of its key, whether the key has more, and its val.

    Where there are second hashes, things that have one key but not one val are kept apart.
    """
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    val = val[order] if val is not None else np.zeros(len(key), np.uint64)
    if not len(key):
        return key, doc, doc, np.zeros(0, bool), val
    other = key[1:] != key[:-1]
    if (~other & (val[1:] != val[:-1])).any():
        order = np.lexsort((doc, val, key))
        key, doc, val = key[order], doc[order], val[order]
        other = (key[1:] != key[:-1]) | (val[1:] != val[:-1])
    keep = np.r_[True, other | (doc[1:] != doc[:-1])]
    first = np.r_[True, other][keep]
    key, doc, val = key[keep], doc[keep], val[keep]
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.r_[at, len(key)])
    return key, doc, doc[at][group], size[group] > 1, val


def pair_codes(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64)) ^ key


class Members:
    """Membership in a set of 64-bit codes: a small table of bits first, then a search."""

    def __init__(self, codes: np.ndarray, bits: int = 20):
        self.codes, self.mask = np.unique(codes), np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.codes & self.mask).astype(np.int64)] = True

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[(codes & self.mask).astype(np.int64)] if len(self.codes) else np.zeros(len(codes), bool)
        maybe = np.flatnonzero(found)
        if len(maybe):
            place = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
            found[maybe] = self.codes[place] == codes[maybe]
        return found


def doc_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and which of them are null."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.int64())
    null = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)).astype(np.int64), null


def send(docs: DataFrame, work: Callable, n: int) -> DataFrame:
    """work(data, offsets) gives (tag, key, row, second hash or None) for the texts of a batch.

    SENT: a fingerprint seen in several documents of one task is known to be shared: those documents
    are told (SHARED) at once, and only the smallest of them is sent on. SENT_TEXT: the two hashes of a
    whole text; all documents of the task that have them but the smallest are told that they are copies.
    """

    def tasks(batches):
        found: dict[int, list] = {}
        size = 0

        def rows():
            out = []
            for tag, parts in found.items():
                key, doc, val = zip(*parts)
                key, doc, least, many, val = distinct_pairs(np.concatenate(key), np.concatenate(doc), np.concatenate(val) if tag == SENT_TEXT else None)
                told, lone = (many, SHARED) if tag == SENT else (doc > least, COPY), doc == least
                out += spread(told[1], n + doc_bucket(doc[told[0]], n), doc[told[0]], key[told[0]])
                out += spread(tag, key_bucket(key[lone], n), doc[lone], key[lone], val[lone] if tag == SENT_TEXT else None)
            found.clear()
            return as_batch(out)

        for batch in batches:
            doc, null = doc_ids(batch.column(0))
            data, offsets = text_buffers(batch.column(1))
            for tag, key, row, val in work(data, offsets):
                known = ~null[row]
                found.setdefault(tag, []).append((key[known], doc[row[known]], val[known] if val is not None else None))
            size += len(data)
            if size >= SEND_BYTES:
                yield rows()
                size = 0
        yield rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tasks, ROWS)


def settle(rows: DataFrame, work: Callable) -> DataFrame:
    """work(frame of one key bucket) gives rows; rows of documents only pass through."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        return as_pandas(work(frame))

    return rows.groupBy("bucket").applyInPandas(group, ROWS)


def meet(docs: DataFrame, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Bring what was found to the texts of its documents: work(texts, rows) for each bucket of documents."""
    return docs.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(work, schema)


#: Tags of rows.
SENT, SHARED, SENT_TEXT, COPY, SENT_CONTEXT, SENT_LEFT, SENT_RIGHT, DROP_RUN, EDGE_LEFT, EDGE_RIGHT, DROP_WINDOW = range(11)


def passed(frame: pd.DataFrame, n: int) -> list[tuple] | None:
    """The rows of a bucket of documents, renumbered and joined to one for each tag; None for a bucket of keys."""
    bucket = int(frame["bucket"].iloc[0])
    if bucket < n:
        return None
    out = []
    for tag in sorted(set(frame["tag"])):
        doc, key = gathered(frame, tag)
        order = np.argsort(key, kind="stable")
        out.append((bucket - n, int(tag), packed(doc[order]), packed_keys(key[order]), None))
    return out


def windows_settled(n: int) -> Callable:
    """For settle(): of the documents with a window, all but the smallest are to drop it."""

    def work(frame: pd.DataFrame) -> list[tuple]:
        if (rows := passed(frame, n)) is not None:
            return rows
        doc, key, val = gathered(frame, SENT, with_val=True)
        key, doc, least, _, _ = distinct_pairs(key, doc, val)
        later = doc > least
        return spread(DROP_WINDOW, doc_bucket(doc[later], n), doc[later], key[later])

    return work


def windows_sent(key: np.ndarray, doc: np.ndarray, val: np.ndarray, n: int) -> list[tuple]:
    """Rows for windows_settled(): what this task can settle itself, and the smallest document of each window."""
    key, doc, least, _, val = distinct_pairs(key, doc, val & SECOND)
    later = doc > least
    own = spread(DROP_WINDOW, n + doc_bucket(doc[later], n), doc[later], key[later])
    return own + spread(SENT, key_bucket(key[~later], n), doc[~later], key[~later], val[~later])
