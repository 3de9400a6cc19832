"""Held-out accuracy of the learned operators, their statistics against brute force, and edges."""

import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from recordloom.llm import language, learning, quality, rules
from recordloom.llm.queries import op7_language_id, op9_quality_rules, op10_quality_classifier

SF = "/root/testdata/sf0.01"


def stats_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover))


TRICKY = ["", None, "\n\n", "a", "a\na\na ", "é ü x\né ü x", "x y z " * 9, "#*$%&|<>", "l1\r\nl1\r\nl1", "a b\n\n a b\na b", "q" * 5000, "same line\n" * 50]


def test_stats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id bigint, text string")
    got = rules.with_stats(docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(got) == 300 + len(TRICKY)
    for r in got:
        assert tuple(r[c] for c in rules.COUNTS[:5]) == stats_by_hand(r.text), r.text


def test_stats_do_not_rest_on_hashes(monkeypatch):
    """Texts made to deceive a linear hash, and a hash that finds all texts of one length equal."""
    import pyarrow as pa

    from recordloom.llm.texts import Rolling, text_buffers
    from tests.llm.test_repeats import signs

    texts = [t or "" for t in TRICKY] + ["\n".join(signs(40)), " ".join(signs(1)), "ab cd ef gh ij kl mn op " * 3 + "qr st\nab cd\nqr uv\nqr uv"]
    buffers = text_buffers(pa.array(texts))
    want = [(*stats_by_hand(t), len(set(re.findall(r"[^\x20\x09-\x0D]+", t)))) for t in texts]

    def got():
        return [(*r[:5], r[-1]) for r in rules.count_stats(*buffers).tolist()]

    assert got() == want
    monkeypatch.setattr(Rolling, "slices", lambda self, starts, ends: (ends - starts).astype(np.uint64))
    assert got() == want


def test_rules_query(spark):
    out = op9_quality_rules(spark, SF).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    assert not any(r.kept and r.base_failed for r in out)
    judged = [(marks[r.doc_id], r.kept) for r in out if r.doc_id in marks and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.99
    assert np.mean([k for q, k in judged if q == 0]) < 0.1


def test_list_is_ordered_and_emitted(spark):
    rng = np.random.default_rng(1)
    x = {k: rng.random(3000) for k in ("symbols", "upper")}
    bad = ((x["symbols"] > 0.8) & (x["upper"] < 0.5)) | (x["upper"] > 0.95)
    found = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= r.covers(x)
    assert np.mean(hit == bad) > 0.97 and all(str(r) for r in found)
    assert rules.learn(x, np.zeros(3000, bool)) == []


def test_rules_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 30, 7), (None, None, 7), (1, "word " * 30, 7), (2, "a b c d e f g h i j k l m n o p q r s t u", 7)], "doc_id bigint, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert sorted(str((r.doc_id, r.kept)) for r in rules.judge(docs, labels).collect()) == ["(1, False)", "(1, False)", "(2, True)", "(None, False)"]
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.select("doc_id", "n_words").collect()] == [(2, 7)]
    assert rules.judge(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0)], "doc_id bigint, quality int")
    assert rules.judge(docs, odd).count() == 4


def test_language_query(spark):
    out = op7_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "123 ...", "en", "x"), (3, "", None, "x"), (4, "la maison est grande", "fr", "x"), (4, "la maison est grande", "fr", "x")], "doc_id bigint, text string, lang string, score string")
    none = language.identify(docs, language.train(docs.filter("lang is null")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    some = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert [some[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and some[4].lang_pred in ("en", "fr")
    assert language.identify(docs.limit(0), None).count() == 0


@pytest.mark.parametrize("count", [1, 2, 4, 30])
def test_codewords(count):
    code = language.codewords(count)
    assert len({tuple(r) for r in code}) == count
    if count > 3:
        apart = (code.shape[1] - code @ code.T)[~np.eye(count, dtype=bool)] / 2
        assert apart.min() >= 4  # one wrong bit is always outvoted


def test_quality_query(spark):
    out = op10_quality_classifier(spark, SF)
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(marks, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "good words here", "s"), (3, "&&& ***", "s"), (3, "&&& ***", "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(3, 0), (2, 1), (9, 1), (None, 0), (4, None)], "doc_id bigint, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert out[0].score == out[1].score
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def pieces_by_hand(text, sizes, words, bits):
    """Buckets of all pieces of a text, one piece at a time."""
    from recordloom.llm.subwords import ECHO
    from recordloom.llm.texts import MULTIPLIER, Rolling, byte_codes, mix

    data = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\v\f\r" else b for b in (text or "").encode())

    def code(part):
        return Rolling(byte_codes()[np.frombuffer(part, np.uint8)]).slices([0], [len(part)])

    shift, out = np.uint64(64 - bits), []
    for n in sizes:
        for i in range(len(data) - n + 1):
            if b" " not in data[i + 1 : i + n - 1] and data[i : i + n] != b" ":
                out.append(int((code(data[i : i + n]) * np.uint64(MULTIPLIER) >> shift)[0]))
    if words:
        found = [w for w in data.split(b" ") if w]
        out += [int((mix(code(w)) >> shift)[0]) for w in found] + [ECHO for a, b in zip(found, found[1:]) if a == b]
    return out


SHORT = ["", None, "a", "The cat, the cat sat", "é è é è  à\tà", "una casa blanca", "der Hund und die Katze", "x" * 40, "le le le chat"]


def test_language_by_hand(spark):
    rows = [(i, t, ("en", "fr", "es", "de")[i % 4]) for i, t in enumerate(SHORT * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    coder = language.train(docs)
    for r in language.identify(docs, coder).collect():
        if not re.search(r"[^\W\d_]", r.text if "text" in r else rows[r.doc_id][1] or ""):
            assert (r.lang_pred, r.score) == ("und", 1.0)
            continue
        buckets = pieces_by_hand(rows[r.doc_id][1], language.SIZES, False, language.BITS)
        share = np.bincount(buckets, minlength=1 << language.BITS) / len(buckets)
        margin = np.clip(share @ coder.weights + coder.bias, -8, 8)
        loss = [sum(abs(m) * np.log1p(np.exp(-m * c)) for m, c in zip(margin, code)) for code in coder.code]
        assert r.lang_pred == coder.names[int(np.argmin(loss))]
        assert abs(r.score - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-4


def test_quality_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(SHORT * 2)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2 * len(SHORT))], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect():
        buckets = pieces_by_hand((SHORT * 2)[r.doc_id], quality.SIZES, True, quality.BITS)
        hidden = np.mean([model.vectors[b] for b in buckets], axis=0) if buckets else np.zeros(quality.DIMENSIONS)
        logit = hidden @ model.layer + model.bias
        assert abs(r.score - np.exp(logit[1]) / np.exp(logit).sum()) < 1e-5


def test_verdicts_by_hand(spark, sf_dir):
    """kept of every row, with the learned rules read one after another."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = rules.train(rules.with_stats(docs.select("doc_id", "text")).drop("text"), rules.sampled(labels))
    assert found
    for r in rules.judge(docs, labels).collect():
        w, lines, chars = max(r.n_words, 1), max(r.n_lines, 1), max(r.word_chars, 1)
        x = {"n_words": r.n_words, "mean_word": r.word_chars / w, "symbols": r.n_symbols / w, "dup_lines": r.n_dup_lines / lines, "repeats": r.n_repeat_words / w, "line_words": r.n_words / lines,
             "upper": r.n_upper / chars, "digits": r.n_digits / chars, "marks": r.n_marks / w, "distinct": r.n_distinct_words / w}
        rejected = any(all((x[n] >= t) if above else (x[n] < t) for n, above, t in rule.conditions) for rule in found)
        assert r.kept == (not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not rejected)


def test_sample_is_bounded_in_rows(spark):
    one = spark.range(100_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 2).cast("int").alias("quality"))
    found = learning.sample(one, "quality", 10).collect()
    assert len(found) == 10 and found == learning.sample(one.repartition(7), "quality", 10).collect()
