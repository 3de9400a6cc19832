"""Every operator and stage on tables with odd columns, nulls, repeated rows, a very long text, and no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import clustering, conversations, decontamination, language, minhash, packing, pii, quality, queries, recompression, rules, sharding, simhash, suffix_index, tokens

SCHEMA = "doc_id bigint, text string, lang string, `a.b` string, `__text` string, `stays_id` int, `n_words` string, `spans` string, `score` string, `x` int"
_random = random.Random(3)
LONG = " ".join(f"w{_random.randrange(5000)}" for _ in range(60_000)) + " me@example.org"
TEXTS = [(1, "Plain words of a text. " * 8), (2, None), (None, "no id here"), (3, ""), (4, "same"), (4, "same"), (5, LONG), (6, "q" * 200_000), (None, None)]


def table(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", "p", "t", 1, "w", "s", "c", 7) for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(2)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "w1 w2 w3"), (None, "plain words of a text"), (2, None), (None, None), (3, "")], "item_id bigint, text string")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d, *queries.vocabulary()),
    "pieces": lambda s, d: packing.best_fit(tokens.token_pieces(d, *queries.vocabulary()).withColumns({"a.b": F.lit(1), "part": F.lit(2)})),
    "words": lambda s, d: recompression.remove_repeated_windows(d),
    "pii": lambda s, d: pii.find_spans(d),
    "redact": lambda s, d: pii.redact(d),
    "benchmark": lambda s, d: decontamination.find_benchmark(d, bench(s)),
    "benchmark blocks": lambda s, d: decontamination.find_benchmark(d, bench(s), block_bytes=10),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near": lambda s, d: simhash.drop_near_duplicates(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "clusters": lambda s, d: clustering.cluster(d.withColumn("v", F.array(F.length("text").cast("double"), F.lit(1.0))), "doc_id", "v", 2, 1),
    "conversations": lambda s, d: conversations.repair(d.select("*", F.col("doc_id").alias("conv_id"), F.col("x").alias("turn"), F.col("lang").alias("role"))),
    "bytes": lambda s, d: suffix_index.remove_repeated_bytes(d),
    "language": lambda s, d: language.identify(d, language.train(d)),
    "shards": lambda s, d: sharding.shard_by_bytes(d, 4),
    "rules": lambda s, d: rules.judge(d, labels(s)),
    "keep": lambda s, d: rules.keep_good(d, labels(s)),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s))),
}
#: Operators that return fewer rows, or other ones, than they are given.
FEWER = {"packing", "pieces", "near", "keep", "clusters", "conversations"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    docs = table(spark)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in FEWER:
        assert len(rows) > 0
    else:
        assert len(rows) == len(TEXTS)
    if "a.b" in out.columns and name != "pieces":
        assert {r["a.b"] for r in rows} == {"p"}
    if name not in ("packing", "pieces"):  # these need a tokenizer's time only once
        assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables_in_stages(spark, name, sf_dir):
    docs = table(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    rows = out.collect()
    assert len(rows) > 0
    if name != "packing":
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert {r["a.b"] for r in rows} == {"p"}


def test_values_of_a_long_text(spark):
    docs = table(spark)
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert found[5].n_email == 1 and found[5].spans == f"email:{len(LONG) - 14}:{len(LONG)}"
    assert {r.doc_id: r.n_words for r in rules.judge(docs, labels(spark)).collect()}[5] == 60_001
    hit = {r.doc_id: r for r in decontamination.find_benchmark(docs, bench(spark)).collect()}
    assert hit[5].n_words == 60_003 and hit[1].n_hit == 40 and hit[1]["items"] == []  # an item without an id is searched for too
    parts = [r for r in packing.pack(docs, *queries.vocabulary()).collect() if r.doc_id == 5]
    assert sum(r.length == 1024 for r in parts) >= len(parts) - 1 and sum(r.length for r in parts) > 60_000
