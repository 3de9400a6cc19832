"""Packing: an exact round trip, against the tokenizer itself, and against a plain best-fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from recordloom.llm.packing import best_fit, match_runs, pack
from recordloom.llm.tokens import encoder

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        gap = min(fit) if fit else capacity
        if fit:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 12), 37, 100]) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    matches = match_runs(counts, 100)
    assert sum(m[2] for m in matches) == 400
    used = {s for _, _, items, begin, each, _ in matches for s in range(begin, begin + -(-items // each))}
    assert len(used) == plain_best_fit(lengths, 100)


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs, *PATHS, with_ids=True).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATHS[0])
    pieces = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for d in docs.collect():
        want, at = [*own.encode(d.text, add_special_tokens=False).ids, 2], 0
        for k, (piece, start, ids) in enumerate(sorted(pieces.pop(d.doc_id))):
            assert piece == k and start == at and ids == want[at : at + len(ids)]
            assert len(ids) == 1024 or k == 0
            at += len(ids)
        assert at == len(want)
    assert not pieces
    n = check_places(rows, 1024)
    assert n == plain_best_fit([r.length for r in rows], 1024)


def test_edges(spark):
    schema = "doc_id bigint, text string, part int, number string"
    rows = [(1, None, 1, ""), (2, "", 1, ""), (None, "x", 1, ""), (3, "a b " * 2000, 1, ""), (4, "same", 1, ""), (4, "same", 1, ""), (5, "<|endoftext|> ᚠ\x85", 1, "")]
    got = pack(spark.createDataFrame(rows, schema), *PATHS, capacity=64, with_ids=True).collect()
    assert check_places(got, 64) >= 1
    assert [r.ids for r in got if r.doc_id in (1, 2)] == [[2], [2]]
    assert len([r for r in got if r.doc_id == 4]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    assert [r.ids[0] for r in got if r.doc_id == 5] == [50256]
    assert pack(spark.createDataFrame([], schema), *PATHS).count() == 0
    clash = spark.createDataFrame([(1, 0, 5, "p", "n", "b")], "doc_id bigint, piece int, length bigint, part string, number string, before string")
    assert best_fit(clash, 8).select("part", "number", "before", "sequence_id", "offset").collect() == [("p", "n", "b", 0, 0)]
    with pytest.raises(Exception, match="capacity"):
        best_fit(spark.createDataFrame([(1, 0, 9)], "doc_id bigint, piece int, length bigint"), 8).collect()


def test_fast_reader_agrees():
    slow, fast = encoder(PATHS[0], None, None), encoder(*PATHS)
    rng = random.Random(4)
    marks = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]] + ["ᚠ", "<|endoftext|>", "字", "\U0001f600"]
    for _ in range(1500):
        text = "".join(rng.choice(marks) if rng.random() < 0.5 else rng.choice("ab 1'st \n\t") for _ in range(rng.randrange(0, 14)))
        assert list(slow(text)) == list(fast(text)), text
