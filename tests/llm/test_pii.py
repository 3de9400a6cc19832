"""Personal data: base spans against plain regular expressions, the estimates, redaction, edges."""

import hashlib
import random
import re

from recordloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows):
    for r in rows:
        want = by_hand(r.text)
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == sum(w[0] == kind for w in want), (kind, r.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (joined, r.spans)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.personal_data(docs).join(docs, "doc_id").collect()
    assert len(rows) == 1000 and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 50
    check(rows)


def test_random_texts(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "256", ".1", "007.0.0.0001", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "+1 (743) 555-3824", "é", "\U0001f600", "x_y%z@q-r.s.t", "12", "(", ")", "\n", "d@e..f", "0", "9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    texts += [None, "", "1" * 3000, "a" * 3000, "a@" * 500, "1 " * 2000, "1.1." * 800, "+" + "1 " * 900]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    check(pii.personal_data(docs).join(docs, "doc_id").collect())


def test_added_spans_and_redaction(spark):
    texts = [f"write to me.{i}@mail.example.com or call +1 (743) 555-38{i:02d} now" for i in range(60)]
    texts += [f"please call (415) 555-01{i:02d} or mail jo.{i} [at] example [dot] com" for i in range(30)]
    texts += [f"order 1234-5678-9012-34{i:02d}, version 300.400.500.6{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, candidates int")
    out = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(out[i].n_email == 1 and out[i].n_phone == 1 for i in range(60))
    assert sum(out[i].n_added for i in range(60, 90)) > 0
    assert all(out[i].n_added == 0 for i in range(90, 120)), [(texts[i], out[i].spans) for i in range(90, 120)]
    red = pii.redact(docs)
    assert red.columns == docs.columns
    rows = {r.doc_id: r for r in red.collect()}
    assert rows[0].text == "write to [EMAIL] or call [PHONE] now" and rows[0].spans == "s"
    assert rows[90].text == texts[90]


def test_estimate_finds_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(20_000):
        true = rng.random() < 0.5
        votes = [(1 if true == (rng.random() < p) else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.6, 0.85, 0.9)]
        key = ("card", *votes)
        counts[key] = counts.get(key, 0) + 1
    soft, right = pii.estimate(counts)
    assert right["before"] < 0.68 and right["strict"] > 0.9
    model = pii.fit(counts)
    assert model.weight[("strict", 1)] > model.weight[("before", 1)] > 0


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, "a@b.co"), (1, "a@b.co")], "doc_id bigint, text string")
    assert sorted(r.spans for r in pii.personal_data(docs).collect()) == ["", "", "email:0:6", "email:0:6"]
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert [r.text for r in pii.redact(docs.limit(1)).collect()] == [None]


def redacted_by_hand(text, spans):
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if start >= at:
            out.append(f"{text[at:start]}[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_texts_of_many_matches(spark):
    """Thousands of strict and loose matches in one text, with characters of one to four bytes and byte-order marks between."""
    rng = random.Random(9)
    fill = ["é", "\U0001f600", " call ", "\ufeff", "\ufffe", " version ", "x", "\n"]
    bits = ["(415) 555-0123", "+1 (743) 555-3824", "a.b@c.org", "10.0.0.1", "4111 1111 1111 1111", "300.1.1.1", "1234-5678-9012-3456", "jo [at] example [dot] com", "4111111111111111@x.de"]
    texts = ["".join(rng.choice(bits) + " " + rng.choice(fill) + " " for _ in range(n)) for n in (3, 255, 256, 257, 700, 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.train(docs)
    rows = pii.personal_data(docs, model).join(docs, "doc_id").collect()
    check(rows)
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(","))] for r in rows}
    assert sum(r.n_added for r in rows) > 100
    for r in rows:
        base = [w for w in by_hand(r.text)]
        for kind, start, end in set(spans[r.doc_id]) - set(base):
            assert not any(a < end and start < b for _, a, b in base), (kind, start, end)
    assert {r.doc_id: r.text for r in pii.redact(docs, model).collect()} == {k: redacted_by_hand(t, spans[k]) for k, t in enumerate(texts)}
