"""Centroid clustering (Lloyd's rounds) with block-norm screening, exact in integers.

A vector is cut into segments, and the norm of each segment is computed once and stored: the compressed vector. By
Cauchy-Schwarz no distance is less than that of the two compressed vectors, |v - c|^2 >= sum((|v_s| - |c_s|)^2), so a
centroid whose bound exceeds the best exact distance so far is discarded without looking at its components. Only
the others receive exact integer distances.

The vectors are read once, stored as integers, and passed over once a round. A task adds up its vectors by
cluster, so a round shuffles clusters x components numbers a task, whatever the clusters' sizes; the driver
sees the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name, map_arrow, own_columns, quoted, stored

#: Components of a segment.
SEGMENT = 8
#: Vectors worked on at once.
ROWS = 4096
#: Largest magnitude of an integer component: squared distances of up to 64 components then fit in 63 bits.
LARGEST = 1 << 27
#: Slack of the bounds, which are computed in doubles: a part of the value.
SLACK = 1e-9


def integer_vectors(frame: DataFrame, column: str, size: int, scale: int, name: str) -> DataFrame:
    """Rows whose vector has exactly ``size`` components, all finite, with floor(scale * component) as ``name`` (array of int).

    A component of more than LARGEST in magnitude, whose distances a long may not hold, is an error.
    """
    x = F.transform(F.col(quoted(column)), lambda v: v.cast("double"))
    # null lengths and null components make the condition null: such rows go
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    floored = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    far = F.exists(x, lambda v: F.abs(v * float(scale)) > float(LARGEST))
    checked = F.when(far, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).otherwise(F.transform(floored, lambda v: v.cast("int")))
    return frame.filter(whole).withColumn(name, checked)


def norms_of(values: np.ndarray) -> np.ndarray:
    """Segment norms of rows of integers; the last segment may be short."""
    squares = values.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, values.shape[1], SEGMENT), axis=1))


def screened(bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """False where a lower bound shows that a centroid is farther than the best one so far; a tie is never screened out."""
    return bound * (1 - SLACK) - 1 <= best


def nearest(values: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact distances were needed."""
    compressed = norms_of(centroids)
    bound = np.stack([((norms - c) ** 2).sum(axis=1) for c in compressed], axis=1)
    label = bound.argmin(axis=1)
    best = ((values - centroids[label]) ** 2).sum(axis=1)
    first, exact = label.copy(), len(values)
    for k, centroid in enumerate(centroids):
        open_ = np.flatnonzero(screened(bound[:, k], best) & (first != k))
        exact += len(open_)
        distance = ((values[open_] - centroid) ** 2).sum(axis=1)
        better = (distance < best[open_]) | ((distance == best[open_]) & (k < label[open_]))
        label[open_[better]], best[open_[better]] = k, distance[better]
    return label, best, exact


def _matrix(column, size: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(kind, copy=False)


def _parts(batch: pa.RecordBatch, size: int, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, values, label, distance) of parts of a batch whose last two columns are vectors and norms."""
    segments = -(-size // SEGMENT)
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        values = _matrix(part.column(part.num_columns - 2), size, np.int64)
        label, distance, _ = nearest(values, _matrix(part.column(part.num_columns - 1), segments, np.float64), centroids)
        yield at, values, label, distance


def compressed(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (last column: vectors of integers) with the segment norms as a last column, stored."""
    schema = T.StructType([*rows.schema.fields, T.StructField(free_name(rows, "norms"), T.ArrayType(T.DoubleType()))])
    names, segments = schema.names, -(-size // SEGMENT)

    def tasks(batches):
        for batch in batches:
            norms = norms_of(_matrix(batch.column(batch.num_columns - 1), size, np.int64)) if batch.num_rows else np.zeros((0, segments))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * segments), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return stored(map_arrow(rows, tasks, schema))


def totals(vectors: DataFrame, size: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid is nearest to, and their sums (exact, of Python integers)."""
    k = len(centroids)

    def tasks(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for _, values, label, _ in _parts(batch, size, centroids):
                count += np.bincount(label, minlength=k)
                order = np.argsort(label, kind="stable")
                some = np.unique(label)
                total[some] += np.add.reduceat(values[order], np.searchsorted(label[order], some), axis=0)
        if count.any():
            slots = np.arange(k * (size + 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.concatenate([total, count[:, None]], axis=1).ravel())], names=["slot", "value"])

    # clusters x components rows, of any number of vectors
    sums = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("value", T.LongType())])
    found = map_arrow(vectors, tasks, sums).groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros(k * (size + 1), object)
    for slot, value in found:
        out[slot] = int(value)
    out = out.reshape(k, size + 1)
    return out[:, -1], out[:, :-1]


def moved(centroids: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Every centroid replaced by floor(sum / count) of its vectors; one without vectors stays."""
    return np.array([[int(s) // int(n) for s in row] if n else old for old, n, row in zip(centroids.tolist(), count, total)], np.int64).reshape(centroids.shape)


def first_centroids(vectors: DataFrame, key: str, name: str, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of salt and key (ties, such as a repeated key: the least vector); rows without a key come last."""
    order = F.sha2(F.concat(F.lit(salt), F.col(quoted(key)).cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("o"), F.col(quoted(name)).alias("v")).orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """Lloyd's rounds on integer vectors: the columns of ``frame`` but for ``vector``, and cluster, distance, centroid, cluster_inertia, inertia.

    Kept are rows whose ``vector`` has exactly ``size`` components, none null or not finite; each component x becomes
    floor(scale * x). The first centroids are the ``k`` kept vectors of the smallest sha256 of ``salt`` and the key, or
    all where fewer are kept; a null key comes last, equal keys by their vectors. Each of ``rounds`` assigns every vector to its nearest
    centroid (squared distance; ties: the smaller number) and replaces each centroid that has vectors by their componentwise
    floor(sum / count); rounds after one that moves nothing would move nothing and are left out. Repeated rows all count.
    Without kept rows there are no rows. A column of the frame that has a result's name is replaced. A component
    beyond LARGEST / scale is an error, as a long may not hold its distances.
    """
    results = {"cluster": T.IntegerType(), "distance": T.LongType()}
    replaced = {vector.lower(), *results, "centroid", "cluster_inertia", "inertia"} - {key.lower()}
    own = [c for c in frame.columns if c.lower() not in replaced]
    name = free_name(frame, "integers")
    kept = integer_vectors(frame, vector, size, scale, name).select(*[quoted(c) for c in own], name)
    vectors = compressed(kept, size)
    centroids = first_centroids(vectors, key, name, k, salt)
    schema = T.StructType([*(vectors.schema[c] for c in own), *(T.StructField(n, kind) for n, kind in results.items())])
    if not len(centroids):
        ends = {"centroid": "array<bigint>", "cluster_inertia": "bigint", "inertia": "bigint"}
        return frame.sparkSession.createDataFrame([], schema).withColumns({n: F.lit(None).cast(kind) for n, kind in ends.items()})
    for _ in range(rounds):
        before, centroids = centroids, moved(centroids, *totals(vectors, size, centroids))
        if (before == centroids).all():
            break

    names = schema.names

    def tasks(batches):
        for batch in batches:
            parts = [(label, distance) for _, _, label, distance in _parts(batch, size, centroids)]
            found = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found[0].astype(np.int32)), pa.array(found[1])], names=names)

    assigned = stored(map_arrow(vectors, tasks, schema))
    sums = {c: int(s) for c, s in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    described = [(c, [int(x) for x in row], sums.get(c, 0), sum(sums.values())) for c, row in enumerate(centroids)]
    # a row for each centroid
    about = F.broadcast(frame.sparkSession.createDataFrame(described, "`cluster` int, `centroid` array<bigint>, `cluster_inertia` bigint, `inertia` bigint"))
    joined = assigned.join(about, "cluster")
    return joined.select(*own_columns(assigned), "centroid", "cluster_inertia", "inertia")


def centroid_digest(centroid: list[int]) -> str:
    """sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
