"""SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from recordloom.llm import simhash
from recordloom.llm.components import roots
from recordloom.llm.simhash import cell_links, drop_near_duplicates, near_duplicates


def fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, bits):
    """node -> least node within reach."""
    left, out = sorted(nodes), {}
    while left:
        front, seen = [left[0]], {left[0]}
        while front:
            one = front.pop()
            near = [x for x in left if x not in seen and (x ^ one).bit_count() <= bits]
            seen.update(near)
            front += near
        out |= dict.fromkeys(seen, min(seen))
        left = [x for x in left if x not in seen]
    return out


def by_hand(rows, k, bits):
    prints = [fingerprint(t, k) for _, t in rows]
    of = groups(set(prints), bits)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[of[p]] = min(doc, least.get(of[p], doc))
    return sorted(((doc, f"{p:016x}", least.get(of[p])) for (doc, _), p in zip(rows, prints)), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for k in (4, 5):
        got = near_duplicates(docs, shingle=k).collect()
        assert sorted(map(tuple, got), key=str) == by_hand(rows, k, 4)


def near_copies():
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(400)] = f"n{i}"
        rows.append((i + 10, " ".join(words).upper() if i % 2 else "  ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "a B"), (None, "a b"), (5, "Ä b"), (200, rows[0][1]), (200, rows[0][1]), (None, None)]


def test_near_copies_and_edges(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, x string, root int").repartition(3)
    docs = docs.withColumnsRenamed({"x": "a.b", "root": "stays_id"})
    want = by_hand(rows, 4, 4)
    assert sorted(map(tuple, near_duplicates(docs, shingle=4).collect()), key=str) == want
    kept = drop_near_duplicates(docs, shingle=4)
    assert kept.columns == docs.columns
    left = sorted(r.doc_id for r in kept.collect())
    assert left == [1, 4, 5, 10]  # 1 to 3 have no words, 4 has a twin without an id, 10 begins the near copies
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
    assert drop_near_duplicates(spark.createDataFrame([(None, "q"), (None, "q")], "doc_id bigint, text string")).count() == 1


def test_cell_links_connect_all():
    rng = np.random.default_rng(1)
    x = np.r_[rng.integers(0, 1 << 63, 30), (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64))].astype(np.uint64)
    x = np.unique(x)
    cell = np.r_[np.zeros(20, np.int64), np.ones(len(x) - 21, np.int64), [7]]
    left, right = cell_links(cell, x, 4)
    assert all(int(x[a] ^ x[b]).bit_count() <= 4 and cell[a] == cell[b] for a, b in zip(left, right)) and len(left) < len(x)
    for c in (0, 1, 7):
        mine, of = x[cell == c].tolist(), {}
        for v in mine:
            of[v] = v
        for a, b in zip(left, right):
            if cell[a] == c:
                p, q = of[int(x[a])], of[int(x[b])]
                of = {k: min(p, q) if v in (p, q) else v for k, v in of.items()}
        assert of == groups(mine, 4)
    assert len(cell_links(cell[:0], x[:0], 4)[0]) == 0


@pytest.mark.parametrize(("agree", "block"), [(2, 7), (3, 4096), (4, 50)])
def test_cells_in_blocks_and_of_more_parts(spark, monkeypatch, agree, block):
    """Any number of agreeing blocks, and cells dealt as pairs of blocks, give the same components."""
    monkeypatch.setattr(simhash, "MOST_BLOCKED", 1 << 40)
    rng = random.Random(agree)
    x = {rng.getrandbits(64) for _ in range(300)}
    for v in list(x)[:60]:
        for _ in range(6):
            x.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    x |= {sum(1 << b for b in rng.sample(range(40, 52), 3)) for _ in range(150)}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "x bigint").selectExpr("x", "x AS node").repartition(3)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in roots(simhash.links(nodes, 4, agree, block)).collect()}
    want, got = groups(x, 4), {}
    for v in x:
        got.setdefault(found.get(v, v), set()).add(v)
    parts: dict = {}
    for v in x:
        parts.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts.values()))


def test_most_rows_in_one_component(spark):
    """One text that half of all rows have, and near copies of it."""
    rows = near_copies()
    rows += [(1000 + i, rows[0][1]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, near_duplicates(docs, shingle=4).collect()), key=str) == by_hand(rows, 4, 4)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    of = {v: v for p in pairs for v in p}
    for a, b in pairs:
        of = {k: min(of[a], of[b]) if v in (of[a], of[b]) else v for k, v in of.items()}
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    for bound in (10_000, 0):
        got = {r.node: r.root for r in roots(spark.createDataFrame(pairs, "a bigint, b bigint"), bound).collect()}
        assert got == {k: v for k, v in of.items() if k in linked}
        assert roots(spark.createDataFrame([], "a bigint, b bigint"), bound).count() == 0


def shingles(text, k=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_wide_fingerprints_find_similar_texts(spark):
    """Of pairs with a Jaccard similarity of 0.8 or more on five-word shingles, nearly all lose one; unrelated texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 60")
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    by: dict = {}
    for d, s in texts.items():
        for g in s:
            by.setdefault(g, []).append(d)
    shared: dict = {}
    for ds in by.values():
        for i, a in enumerate(ds[:200]):
            for b in ds[:i]:
                shared[b, a] = shared.get((b, a), 0) + 1
    alike = {p: n / (len(texts[p[0]]) + len(texts[p[1]]) - n) for p, n in shared.items()}
    kept = {r.doc_id for r in drop_near_duplicates(docs).select("doc_id").collect()}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert len(near) > 20 and sum(not (a in kept and b in kept) for a, b in near) >= 0.95 * len(near)
    lone = set(texts) - {d for p, j in alike.items() if j >= 0.4 for d in p}
    assert lone <= kept
