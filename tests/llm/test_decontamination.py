"""Benchmark search against brute force."""

import hashlib
import random
import re

import pytest

from recordloom.llm.decontamination import contamination, find_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, width):
    patterns = {}
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1) if size else ():
            patterns.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in patterns:
                    hit |= set(range(i, i + size))
                    found |= patterns[p]
        joined = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def small():
    rng = random.Random(8)
    vocab = ["a", "B", "cé", "d1", "É", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 16)))) for i in range(25)] + [(3, "a B"), (99, None), (98, "--"), (10, "Solo"), (7, "a"), (None, "d1 É x"), (None, None)]
    docs = []
    for i in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.5:
            text[3:3] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(None, "a b cé"), (60, None), (61, ""), (5, docs[5][1]), (62, "a " * 4000)], items


@pytest.mark.parametrize(("width", "limit"), [(10, None), (4, None), (3, 60)])
def test_small(spark, width, limit):
    docs, items = small()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # one block, or several, which must come to the same
    got = contamination(table, bench, width, *([limit] if limit else [])).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(docs, items, width)


def test_whole_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], 10)
    assert sorted(map(tuple, contamination(docs, bench).collect()), key=str) == want
    assert any(r[-1] for r in want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "One two three", 5, "x", [2])], "doc_id bigint, text string, n_hit int, row string, items array<int>")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in find_benchmark(docs, none).select("doc_id", "row", "n_words", "n_hit", "items").collect()] == [(1, "x", 3, 0, [])]
    assert contamination(docs.limit(0), none).count() == 0
