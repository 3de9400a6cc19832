"""Clustering against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import clustering
from recordloom.llm.queries import op11_centroid_clustering


def plain(rows, size, scale, k, rounds, salt="3:"):
    """[(id, cluster, distance)] and centroids of rows (id, vector)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"{salt}{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centres = [v for _, v in sorted(kept, key=order)[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    return [(i, assign(v)[1], assign(v)[0]) for i, v in kept], centres


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centres = plain(rows, 64, 1024, 8, 10)
    total, each = sum(d for *_, d in want), {}
    for _, c, d in want:
        each[c] = each.get(c, 0) + d
    want = sorted((i, c, d, each[c], total, clustering.centroid_digest(centres[c])) for i, c, d in want)
    assert sorted(tuple(r) for r in op11_centroid_clustering(spark, sf).collect()) == want


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.5, 3.0, 100.0]) for _ in range(11)]) for k in range(60)]
    rows += [(3, rows[3][1]), (3, [9.0] * 11), (None, [1.0] * 11), (None, [1.0] * 11), (70, None), (71, []), (72, [1.0] * 10), (73, [1.0] * 10 + [None]), (74, [math.nan] + [0.0] * 10), (75, [-math.inf] + [0.0] * 10)]
    frame = spark.createDataFrame([(i, v, "a", 5, 7.0) for i, v in rows], "vec_id bigint, embedding array<double>, `a.b` string, cluster int, norms double").repartition(3)
    found = clustering.cluster(frame, size=11, scale=4, k=5, rounds=4)
    assert set(found.columns) == {"vec_id", "a.b", "norms", "cluster", "distance", "centroid", "cluster_inertia", "inertia"}
    want, centres = plain(rows, 11, 4, 5, 4)
    got = found.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), c, d) for i, c, d in want)
    assert all(list(r.centroid) == centres[r.cluster] and r["a.b"] == "a" and r.norms == 7.0 for r in got)
    assert clustering.cluster(frame.limit(0), size=11).collect() == [] and clustering.cluster(frame.limit(0), size=11).columns == found.columns
    few = clustering.cluster(frame.filter("vec_id < 3"), size=11, k=8, rounds=2).collect()
    assert {r.distance for r in few} == {0}
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(frame.withColumn("embedding", F.transform("embedding", lambda x: F.lit(1e30))), size=11).collect()


def test_hot_cluster(spark):
    """A third of all rows are one vector; ties go to the smaller number."""
    rows = [(k, [1.0, 1.0] if k % 3 == 0 else [float(k % 7), float(k % 5)]) for k in range(900)]
    want, _ = plain(rows, 2, 1, 4, 10)
    got = clustering.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), size=2, scale=1, k=4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == sorted(want)


def test_screening_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(-50, 50, (300, 20)) + centre for centre in (0, 400, 900)])
    centroids = np.stack([np.full(20, c) for c in (0, 400, 900, 900, 5000)])
    label, best, exact = clustering.nearest(values, clustering.norms_of(values), centroids)
    distances = ((values[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (label == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()
    assert exact < 0.4 * distances.size
