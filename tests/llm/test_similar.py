"""Groups of similar texts against brute force over all pairs."""

import random

from recordloom.llm import similar
from recordloom.llm.simhash import drop_near_duplicates
from tests.llm.test_simhash import shingles


def stay(rows, similarity=0.8):
    """The least doc_id of each group, by brute force on shingle sets."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if (not x and not sets[j]) or shared and 5 * shared >= 4 * (len(x) + len(sets[j]) - shared):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[k][0] for k in set(root)}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == stay(rows)


def test_between_04_and_08(spark, monkeypatch):
    """Families at every similarity from 0.4 to 1, in groups larger than a block, with common shingles."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(100)]
        for i in range(25):
            words = list(base)
            for at in rng.sample(range(100), rng.randrange(0, 3 + family)):
                words[at] = f"n{family}x{i}"
            rows.append((len(rows), " ".join(words)))
    # one line in front of unrelated texts
    rows += [(1000 + i, "all rights are held by the owner of this page " + " ".join(f"u{i}v{k}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = stay(rows)
    assert 60 < len(want) < len(rows) and {r.doc_id for r in drop_near_duplicates(docs).collect()} == want


def test_exactly_at_the_bound(spark):
    """Eight of ten shingles in common are linked, 15 of 19 are not."""
    one, other = [f"a{k}" for k in range(13)], [f"b{k}" for k in range(20)]
    texts = [one, one[:12], one[1:], one[:10], other, other[:19] + ["z"], other[:17] + ["y"] * 3]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == stay(rows)
