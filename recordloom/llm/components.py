"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

#: Edges (of two longs) that one task may join.
TASK_EDGES = 1_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node tells its larger (or its smaller) neighbours the least node it sees."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    told = both.join(least, "a")
    if large:
        told = told.filter(F.col("b") > F.col("a")).select("b", "least")
        return told.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    own = least.select("a", F.col("least").alias("b"))
    return told.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own).filter("a <> b").distinct()


def _joined(frames):
    """Union of a bounded number of edges inside one task: least labels, with pointers shortened between rounds."""
    frame = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *frames], ignore_index=True)
    nodes, ends = np.unique(frame[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    yield pd.DataFrame({"node": nodes, "root": nodes[label]})


def roots(edges: DataFrame, bound: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the least node that can be reached.

    Large-star and small-star steps in turn until nothing changes, or until at most ``bound`` edges are
    left, which one task joins; the driver sees two numbers a turn. Self-loops and repeated edges do no
    harm; no edges give no rows.
    """
    edges, seen = checkpointed(edges.filter("a <> b").select("a", "b").distinct()), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] <= bound:
            return edges.coalesce(1).mapInPandas(_joined, "node bigint, root bigint")
        if now == seen:
            break
        edges, seen = checkpointed(_stars(_stars(edges, large=True), large=False)), now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
