"""The pipeline's stages on whole small tables, each against a plain version, and its edges."""

import re

import corpus_pipeline
from recordloom.llm.rules import judge
from tests.llm.test_decontamination import by_hand as contaminated_by_hand
from tests.llm.test_pii import by_hand as spans_by_hand
from tests.llm.test_similar import stay
from tests.llm.test_simhash import shingles

FUNCTIONS = dict(corpus_pipeline.STAGES)


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = FUNCTIONS["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == columns
    verdicts = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").collect()
    rows = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in rows} == {v.doc_id for v in verdicts} and 0 < len(rows) < 200

    docs = spark.createDataFrame(rows, kept.schema)
    single = FUNCTIONS["near_dedup"](spark, docs, sf_dir)
    assert single.columns == columns
    before, rows = rows, [tuple(r) for r in single.collect()]
    assert {r[0] for r in rows} == stay([r[:2] for r in before])
    assert len({frozenset(shingles(r[1])) for r in rows}) == len(rows)

    docs = spark.createDataFrame(rows, kept.schema)
    clean = FUNCTIONS["decontamination"](spark, docs, sf_dir)
    assert clean.columns == columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated_by_hand([r[:2] for r in rows], bench, 10) if r[-1]}
    rows = [tuple(r) for r in clean.collect()]
    assert {r[0] for r in rows}.isdisjoint(bad) and len(rows) + len(bad) == len(docs.collect())

    docs = spark.createDataFrame(rows, kept.schema)
    masked = FUNCTIONS["pii"](spark, docs, sf_dir)
    assert masked.columns == columns
    before = {r[0]: r[1] for r in rows}
    for r in masked.collect():
        spans = spans_by_hand(before[r.doc_id])
        assert not spans_by_hand(r.text) and r.n_chars == len(r.text)
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)) >= bool(spans)
        if "[" not in r.text:
            assert r.text == before[r.doc_id]

    packed = FUNCTIONS["packing"](spark, masked, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(before) and all(0 <= r.offset and r.offset + r.length <= 1024 for r in packed)


def test_run_and_edges(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({"source": "n_words"})
    null = spark.createDataFrame([(None, None, None, None, None), (3, "", None, None, 0), (3, "", None, None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs.limit(0), null, docs.limit(5)):
            out = stage(spark, frame, sf_dir)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == frame.columns
