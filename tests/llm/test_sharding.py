"""Histogram sort: counts, tolerance, groups of equal texts, skew."""

import pytest
from pyspark.sql import functions as F

from recordloom.llm.sharding import shard_by_bytes, splitters


def rows_of(spark, texts, parts=5):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, part string, hash int").repartition(parts)


def check(out, n):
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in by.values())
    assert all(0 <= s < n for s in by)
    return {s: sum(x["size"] for x in rows) for s, rows in by.items()}, by


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, 8).collect()
    sizes, _ = check(out, 8)
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    assert all(r["size"] == len(r.text.encode()) + 1 for r in out)
    mean, largest = sum(sizes.values()) / 8, max(r["size"] for r in out)
    assert all(abs(s - mean) <= largest + 0.002 * mean for s in sizes.values())


def test_hot_group_is_split(spark):
    texts = ["same text of some length"] * 600 + [f"other {i} " * (i % 7) for i in range(900)]
    out = shard_by_bytes(rows_of(spark, texts), 8).collect()
    sizes, by = check(out, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    assert {r.part for r in out} == {"x"} and {r.hash for r in out} == {1}
    homes = {}
    for r in out:
        homes.setdefault(r.text, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 3


@pytest.mark.parametrize("texts", [[], ["a"], [None, "", "x"], ["dup"] * 20, [None] * 9])
def test_edges(spark, texts):
    sizes, by = check(shard_by_bytes(rows_of(spark, texts, 2), 4).collect(), 4)
    assert sum(len(x) for x in by.values()) == len(texts)


def test_repeated_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "t")] * 8 + [(3, "t")] * 8, "doc_id bigint, text string")
    _, by = check(shard_by_bytes(frame, 4).collect(), 4)
    assert sum(len(x) for x in by.values()) == 16


def test_splitters_are_exact(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("hash"), "id", F.lit(10).cast("bigint").alias("size"))
    bounds = splitters(keys, 4, tolerance=0.0)
    hashes = sorted(r.hash for r in keys.collect())
    assert [sum(h < b for h in hashes) for b, _ in bounds] == [250, 500, 750]
