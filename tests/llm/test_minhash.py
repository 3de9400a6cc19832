"""MinHash near-duplicates against brute force over all pairs of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import minhash
from recordloom.llm.queries import op12_minhash_near_dedup
from recordloom.llm.similar import sets_of
from recordloom.llm.texts import text_buffers

SF = "/root/testdata/sf0.01"


def shingles(text, size=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, size=2, p=4, q=5):
    """[(doc_id, n, component, kept)] of rows (doc_id, text)."""
    sets, root = [shingles(t, size) for _, t in rows], list(range(len(rows)))
    where = {}
    for i, x in enumerate(sets):
        for s in x:
            where.setdefault(s, []).append(i)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        shared = {}
        for s in x:
            for j in where[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n * q >= (len(x) + len(sets[j]) - n) * p:
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(sets[i]), least.get(top(i)), doc is not None and doc == least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(op12_minhash_near_dedup(spark, SF).collect()) == ordered(plain(rows))


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_families_of_every_similarity(spark, monkeypatch, block):
    """Families from copies to a similarity of 0.4, with shingles that all share, in cells larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SEND", 50)
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    rng = random.Random(block)
    rows = []
    for family in range(14):
        base = [f"f{family}w{k}" for k in range(60)] + ["shared", "words", "of", "all"]
        for i in range(30):
            words = list(base)
            for at in rng.sample(range(60), rng.randrange(0, 2 + family)):
                words[at] = f"n{family}x{i}" if rng.random() < 0.7 else f"n{family}x"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain(rows)
    assert ordered(minhash.near_duplicates(frame, shingle=2).collect()) == ordered(want)
    assert 14 < len({r[2] for r in want}) < 300


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, "One two"), (2, "one  TWO"), (3, None), (3, None), (None, ""), (None, "one two"), (4, " \n"), (5, "one"), (6, "ONE"), (7, long), (8, long + " x"), (None, "lone text of no id"), (None, "lone text of no id"), (9, "É é"), (10, "é é"), (2, "another text with this id")]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id bigint, text string, n int, `same` string").repartition(3)
    assert ordered(minhash.near_duplicates(frame, shingle=2).collect()) == ordered(plain(rows))
    assert minhash.near_duplicates(frame.limit(0), shingle=2).collect() == []
    assert ordered(minhash.near_duplicates(frame.filter("text is null"), shingle=2).collect()) == ordered([(3, 0, 3, True)] * 2)


def test_pigeonhole():
    """Signatures that differ in REACH places always share a key; agreement estimates the similarity."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (200, minhash.VALUES)).astype(np.uint8)
    y = x.copy()
    for row in y:
        at = rng.choice(minhash.VALUES, minhash.REACH, replace=False)
        row[at] += rng.integers(1, 256, len(at)).astype(np.uint8)
    assert (minhash.differing(x, y) == minhash.REACH).all()
    assert all(np.intersect1d(a, b).size for a, b in zip(minhash.chunk_keys(x), minhash.chunk_keys(y)))
    first = minhash.first_shared(x, y)
    for a, b, key in zip(minhash.chunk_keys(x), minhash.chunk_keys(y), first):
        shared = [k for k, other in zip(a, b) if k == other]
        assert key in (shared[0], *shared[1 : minhash.WIDTH])
    assert (minhash.first_shared(x, 255 - x)[(x != 255 - x).all(axis=1)] == 0).all()
    texts = [" ".join(f"w{k}" for k in range(n, n + 900)) for n in (0, 100)]
    values, at, _ = sets_of(*text_buffers(pa.array(texts)), 1, np.zeros(0, np.uint64))
    a, b = minhash.signatures(values, at)
    assert abs(minhash.differing(a, b) / minhash.VALUES - 0.2) < 0.11


def test_parity_is_a_bound():
    rng = np.random.default_rng(5)
    for size, other in ((20, 18), (500, 700), (3000, 100)):
        both = rng.integers(0, 2**63, size).astype(np.uint64)
        values = np.r_[both, both[:other] if other < size else np.r_[both, rng.integers(0, 2**63, other - size).astype(np.uint64)]]
        bits, at = minhash.parities(values, np.array([0, size, len(values)]))
        table = minhash.Parities(pa.array([bits[at[k] : at[k + 1]].tobytes() for k in (0, 1)], pa.binary()))
        odd = table.odd(np.array([0, 1, 0]), table, np.array([1, 0, 0]))
        assert 0 < odd[0] <= abs(size - other) and odd[0] == odd[1] and odd[2] == 0
