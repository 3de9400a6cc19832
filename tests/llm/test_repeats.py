"""Passage de-duplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from recordloom.llm.recompression import remove_repeated_windows
from recordloom.llm.suffix_index import Levels, remove_repeated_bytes
from recordloom.llm.texts import Rolling, cuts, space_table, text_buffers, word_bounds, xxh64_long

SCHEMA = "doc_id bigint, text string, lang string"


def words_by_hand(rows, width):
    least = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - width + 1):
            if doc is not None:
                w = tuple(words[i : i + width])
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            if doc is not None and least[tuple(words[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def bytes_by_hand(rows, width):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            if doc is not None:
                least[data[i : i + width]] = min(least.get(data[i : i + width], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if doc is not None and least[data[i : i + width]] < doc:
                gone[i : i + width] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, letters=3, n=60):
    """Small alphabets, long runs, copied passages with edits, copies, nulls, repeated ids."""
    rng = random.Random(seed)
    vocab = ["a", "bé", "cc", "d", "ééé", "f0"][:letters]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            a, b = sorted(rng.sample(range(61), 2))
            words[len(words) // 2 : len(words) // 2] = passage[a:b]
        if rng.random() < 0.2:
            words += [rng.choice(vocab)] * rng.randrange(5, 40)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " "), (n + 2, None), (n + 3, ""), (None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1]), (-4, rows[11][1])]
    return rows


@pytest.mark.parametrize(("seed", "letters"), [(1, 2), (2, 3), (3, 6)])
def test_words(spark, seed, letters):
    rows = corpus(seed, letters)
    got = remove_repeated_windows(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(3)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == words_by_hand(rows, 13)


@pytest.mark.parametrize(("seed", "letters"), [(1, 2), (2, 3), (3, 6)])
def test_bytes(spark, seed, letters):
    rows = corpus(seed, letters)
    got = remove_repeated_bytes(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(3)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == bytes_by_hand(rows, 50)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeated_windows(docs).drop("kept").collect()), key=str) == words_by_hand(rows, 13)
    assert sorted(map(tuple, remove_repeated_bytes(docs).drop("kept").collect()), key=str) == bytes_by_hand(rows, 50)


def test_empty_table_and_kept_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(none).count() == 0 and remove_repeated_bytes(none).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    both = spark.createDataFrame([(1, text, ""), (2, f"new  {text}", "")], SCHEMA)
    assert {r.doc_id: r.kept for r in remove_repeated_windows(both, texts=True).collect()} == {1: text, 2: "new"}
    assert {r.doc_id: bytes(r.kept) for r in remove_repeated_bytes(both, texts=True).collect()} == {1: text.encode(), 2: b"new  "}


def test_level_family():
    rng = np.random.default_rng(5)
    family, seen = Levels(), {}
    for doc in range(40):
        key = np.unique(rng.integers(0, 500, 30).astype(np.uint64))
        family.add(key, np.full(len(key), doc))
        for k in key.tolist():
            seen.setdefault(k, set()).add(doc)
    doc, key = family.shared()
    assert set(zip(key.tolist(), doc.tolist())) == {(k, d) for k, ds in seen.items() if len(ds) > 1 for d in ds}
    assert len(family.levels) <= 12


def test_helpers():
    import pyarrow as pa
    import xxhash

    data, offsets = text_buffers(pa.array(["x", "ab c", None, "", "é f\n"]).slice(1))
    starts, ends, row = word_bounds(data, offsets, space_table())
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends)] == ["ab", "c", "é", "f"] and row.tolist() == [0, 0, 3, 3]
    assert list(cuts(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    rolling = Rolling(np.array([5, 6, 7, 5, 6, 7], np.uint64))
    assert rolling.slices(np.array([0]), np.array([3])) == rolling.slices(np.array([3]), np.array([6]))
    assert (rolling.windows(3) == rolling.slices(np.arange(4), np.arange(4) + 3)).all()
    for v in (0, -7, 1 << 40):
        assert xxh64_long(np.array([v]))[0] == np.uint64(xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), 42)).astype(np.int64)


def test_kept_family_of_batches(spark):
    from recordloom.llm.suffix_family import SuffixFamily

    rows = [(i, t) for i, (d, t) in enumerate(corpus(4, 6, 70)) if d is not None and t]
    family = SuffixFamily(spark, "family_test")
    family.drop()
    docs, got, sizes = spark.createDataFrame(rows, "doc_id bigint, text string"), [], []
    for k in range(0, len(rows), 12):
        batch = docs.filter(f"doc_id >= {rows[k][0]}" + (f" and doc_id < {rows[k + 12][0]}" if k + 12 < len(rows) else ""))
        earlier = docs.filter(f"doc_id < {rows[k][0]}")
        got += [tuple(r) for r in family.add(batch, earlier).drop("kept").collect()]
        sizes.append(len(family.levels()))
    assert sorted(got, key=str) == bytes_by_hand(rows, 50)
    assert max(sizes) <= 5
    assert family.add(docs.limit(0), docs).count() == 0
    family.drop()
    assert not family.levels()


def signs(step, n=20_480):
    """Two texts of equal length in which a Thue-Morse pattern of two letters stands the one way and the other."""
    a, b = (bytearray(b"q" * n) for _ in "ab")
    for k in range(n // step):
        a[k * step], b[k * step] = b"xy" if k.bit_count() % 2 else b"yx"
    return a.decode(), b.decode()


@pytest.mark.parametrize("step", [40, 1])
def test_texts_whose_linear_hashes_are_equal(spark, step):
    a, b = signs(step)
    tail = " ".join(["z"] * 12)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert sorted(map(tuple, remove_repeated_bytes(docs).drop("kept").collect())) == bytes_by_hand([(1, a), (2, b)], 50)
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}")]
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("kept").collect()
    assert sorted(map(tuple, got)) == words_by_hand(rows, 13) and all(r.n_removed == 0 for r in got)


def test_equal_first_hashes_are_told_apart():
    from recordloom.llm.exchange import distinct_pairs

    key, doc, val = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 3, 1, 2]), np.array([8, 9, 8, 8, 9], np.uint64)
    key, doc, least, many, val = distinct_pairs(key, doc, val)
    assert list(zip(key.tolist(), val.tolist(), doc.tolist(), least.tolist(), many.tolist())) == [(5, 8, 1, 1, True), (5, 8, 3, 1, True), (5, 9, 2, 2, False), (7, 8, 1, 1, False)]


def test_long_text(spark):
    """A text of several MB beside one that shares its end; texts without ids do not gather in one bucket."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, "start " + long[-2000:]), *((None, "no id") for _ in range(20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    words = {r.doc_id: r for r in remove_repeated_windows(docs, texts=True).collect()}
    assert words[1].n_removed == 0 and words[1].n_words == 400_000 and len(words[2].kept.split()) <= 2
    data = {r.doc_id: r for r in remove_repeated_bytes(docs, texts=True).collect()}
    assert data[1].n_removed == 0 and data[2].n_removed >= 2000 and data[1].n_bytes == len(long)
