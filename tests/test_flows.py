"""Traces, joint streams, rebased splits and output contracts: plans, refusals, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import outputs
from recordloom.operators.arrays import Threshold
from recordloom.operators.contract import ChainError, ContractError, check_chain
from recordloom.operators.predict import ClassificationPredictions, ModelDetect, ModelPredict, ModelRestore, ModelSegment
from recordloom.operators.structure import Expand, Formula, MapOp, RenameField, SelectFields, Where
from recordloom.plans.record import Flow, Step, StepReferenceError, Stream, records
from recordloom.plans.trace import Tracer, fingerprint
from recordloom.sources import views


def jobs(spark, name, action) -> int:
    """How many jobs an action starts."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        action()
    finally:
        context.setJobGroup("other", "other")
    return len(context.statusTracker().getJobIdsForGroup(name))


def numbers(spark, n=20):
    return records(spark.range(n).select("id", (F.col("id") * 1.5).alias("x"), F.array(F.col("id") - 5.0, F.lit(1.0)).alias("v")), "id")


def flow(spark, low=0.0):
    steps = (
        Step("half", Formula("x / 2", "x", output="half")),
        Step("mask", Threshold("v", low), reads="source"),
        Step("kept", Where("half > 3"), reads="half"),
        Step("both", merges=("mask",)),
    )
    return Flow(numbers(spark), steps)


class TestTracer:
    def test_values_and_states(self, spark, tmp_path):
        t = Tracer(flow(spark), [2, 9], str(tmp_path)).run(until="kept")
        assert t.statuses() == {"half": "done", "mask": "done", "kept": "paused", "both": "not reached"} and t.paused_at == "kept"
        assert t.value("half", "half", 9) == 6.75 and t.value("mask", "mask", 2) == [False, True]
        with pytest.raises(RuntimeError, match="paused"):
            t.record("kept")
        t.step()
        assert t.paused_at == "both" and t.value("kept", "half", 2) is None and t.value("kept", "half", 9) == 6.75
        t.resume()
        assert [r.id for r in t.result().collect()] == [9] and t.changes("mask") == {"added": ["mask"], "changed": [], "dropped": []}
        with pytest.raises(RuntimeError, match="nothing is paused"):
            t.resume()

    def test_a_change_runs_only_what_follows(self, spark, tmp_path):
        t = Tracer(flow(spark), folder=str(tmp_path))
        first = jobs(spark, "first", t.run)
        assert first >= 4 and t.computed == ["half", "mask", "kept", "both"]
        rest = jobs(spark, "rest", lambda: t.rerun_from("kept", text="half > 10"))
        assert t.computed == ["kept", "both"] and rest <= first // 2
        assert t.generations() == {"half": 0, "mask": 0, "kept": 1, "both": 1}
        assert sorted(r.id for r in t.result().collect()) == [14, 15, 16, 17, 18, 19]
        # a change that is taken back finds its results
        assert jobs(spark, "back", lambda: t.rerun_from("kept", text="half > 3")) == 0 and t.computed == []
        assert sorted(r.id for r in t.result().collect()) == list(range(5, 20))
        assert jobs(spark, "again", lambda: Tracer(flow(spark), folder=str(tmp_path)).run()) == 0

    def test_refusals_leave_the_trace(self, spark, tmp_path):
        t = Tracer(flow(spark), folder=str(tmp_path)).run(until="both")
        with pytest.raises(RuntimeError, match="never reached"):
            Tracer(flow(spark), folder=str(tmp_path)).rerun_from("half")
        with pytest.raises(TypeError):
            t.rerun_from("kept", nothing=1)
        with pytest.raises(KeyError):
            t.rerun_from("mask", field="none")
        with pytest.raises(TypeError, match="no operator"):
            t.resume().rerun_from("both", x=1)
        with pytest.raises(StepReferenceError):
            t.run(until="none")
        assert t.generation == 0 and t.statuses()["kept"] == "done"

    def test_expanding_steps(self, spark, tmp_path):
        steps = (Step("parts", Expand("part", lambda r: r["v"])), Step("sum", MapOp(lambda a, b: a + b, ["part", "x"], "sum")))
        t = Tracer(Flow(numbers(spark, 3), steps), folder=str(tmp_path)).run()
        assert [r["sum"] for r in t.result("sum", ordered=True).collect()] == [-5.0, 1.0, -2.5, 2.5, 0.0, 4.0]

    def test_fingerprints(self):
        def step(op):
            return fingerprint("", Step("s", op))

        assert step(Threshold("v", 1.0)) == step(Threshold("v", 1.0)) != step(Threshold("v", 2.0))
        one, two = (lambda k: lambda r: r.put("x", r["x"] + k))(1), (lambda k: lambda r: r.put("x", r["x"] + k))(2)
        assert step(one) != step(two) and step(MapOp(lambda x: x + 1, ["a"], "b")) != step(MapOp(lambda x: x + 2, ["a"], "b"))


class TestJoint:
    def streams(self, spark, folder):
        a = spark.range(10).select("id", F.col("id").cast("string").alias("name"), F.lit(1.5).alias("w"))
        b = spark.range(6).select((F.col("id") * 10).alias("key"), F.lit("b").alias("name"))
        a.write.parquet(f"{folder}/a")
        b.write.parquet(f"{folder}/b")
        one = Stream(records(spark.read.parquet(f"{folder}/a"), "id", {"name": "Label"})).then(Where("id > 3"))
        two = Stream(records(spark.read.parquet(f"{folder}/b"), "key", {"name": "Label"})).then(RenameField("key", "id"))
        return one, two

    def test_rows_positions_and_lengths(self, spark, tmp_path):
        one, two = self.streams(spark, str(tmp_path))
        joint = views.Joint((one, two))
        assert len(joint) == 16 and joint.record().kinds == {"name": "Label"}
        r = joint.record()
        rows = r.put_all({"branch": views.branch(r), "own": views.own_position(r)}).result(ordered=True).collect()
        assert [(x.branch, x.own, x.id, x.w) for x in rows] == [(0, k, k, 1.5) for k in range(4, 10)] + [(1, 10 * k, 10 * k, None) for k in range(6)]

    def test_filters_and_projections_reach_every_scan(self, spark, tmp_path):
        joint = views.Joint(self.streams(spark, str(tmp_path)))
        plan = joint.then(Where("id >= 8")).project(["id"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("GreaterThanOrEqual(id,8)") == 1 and plan.count("GreaterThanOrEqual(key,8)") == 1
        assert "ReadSchema: struct<key:bigint>" in plan and "ReadSchema: struct<id:bigint>" in plan and "Exchange" not in plan

    def test_refusals(self, spark, tmp_path):
        one, two = self.streams(spark, str(tmp_path))
        with pytest.raises(ValueError, match="'id' is bigint in one stream and string in stream 1"):
            views.Joint((one, two.then(MapOp(lambda x: x.cast("string"), ["id"], "id")))).record()
        with pytest.raises(ValueError, match="item type"):
            views.Joint((one, two.then(lambda r: r.put("name", r["name"], "Plain")))).record()
        with pytest.raises(ValueError, match="has a stream"):
            views.Joint(()).record()

    def test_branches_of_different_depth(self, spark):
        one = Stream(numbers(spark, 2)).then(Expand("part", lambda r: r["v"]), SelectFields(["id", "part"]))
        two = Stream(numbers(spark, 2)).then(SelectFields(["id"]))
        assert [(r.id, r.part) for r in views.Joint((one, two)).result(ordered=True).collect()] == [(0, -5.0), (0, 1.0), (1, -4.0), (1, 1.0), (0, None), (1, None)]


class TestRebasedSplit:
    def test_parts_are_numbered_in_the_shuffled_order(self, spark, monkeypatch):
        monkeypatch.setattr(views, "RANKED", 7)
        source = numbers(spark, 200)
        seen = []
        for part in ("train", "val", "test"):
            r = views.split_view(source, part, 0.2, 0.1, 5, rebased=True)
            rows = r.result(position="_idx").orderBy("_idx").collect()
            assert [x["_idx"] for x in rows] == list(range(len(rows)))
            hashes = [x[0] for x in spark.createDataFrame([(x.id,) for x in rows], "id bigint").select(F.md5(F.concat(F.lit("5/"), F.col("id").cast("string")))).collect()]
            assert hashes == sorted(hashes)
            seen += [x.id for x in rows]
            assert sorted(x.id for x in rows) == sorted(x.id for x in views.split_view(source, part, 0.2, 0.1, 5).result().collect())
        assert sorted(seen) == list(range(200))

    def test_small_sources(self, spark):
        assert views.split_view(numbers(spark, 0), "val", 0.5, seed=1, rebased=True).result().collect() == []
        assert [r["_idx"] for r in views.split_view(numbers(spark, 1), "val", 0.5, seed=1, rebased=True).result(position="_idx").collect()] == [0]


def model():
    return lambda x: np.asarray(x)


MODELS = {"ModelPredict": ModelPredict(model, "v"), "ModelSegment": ModelSegment(model, "v"), "ModelRestore": ModelRestore(model, "v"), "ModelDetect": ModelDetect(model, "v", (1, 1))}


class TestOutputContracts:
    @pytest.mark.parametrize("name", sorted(MODELS))
    def test_refused_before_any_job(self, spark, name):
        from dataclasses import replace

        op, r = MODELS[name], numbers(spark)

        def refused(bad, record, text):
            with pytest.raises(ContractError, match=text):
                bad(record)

        def all_of_them():
            refused(replace(op, build=3), r, f"{name}: build is a int")
            refused(replace(op, field="none"), r, f"{name}: no entry 'none'")
            refused(replace(op, field="x"), r, f"{name}: entry 'x' is double")
            refused(op, r.put("v", F.array(F.lit("a"))), f"{name}: entry 'v' is array<string>")
            assert set(op.produces) <= set(op(r).entries)

        assert jobs(spark, f"refusals {name}", all_of_them) == 0

    def test_results_are_held_to_the_contract(self, spark):
        r = numbers(spark)
        scored = r.put_all({"s_scores": r["v"], "probs": r["v"], "class_idx": r["x"]})
        with pytest.raises(ContractError, match="'class_idx' of classification .* is double, not bigint"):
            outputs.CLASSIFICATION.check(scored, "s", "me")
        with pytest.raises(ContractError, match="me: classification lacks 'probs'"):
            outputs.CLASSIFICATION.check(r.put("s_scores", r["v"]), "s", "me")
        with pytest.raises(ContractError, match="lacks 'scores'"):
            outputs.DETECTION.check(r.put("t", F.struct(F.array(F.struct(F.lit(1.0).alias("x0"))).alias("boxes"), F.array(F.lit(1).cast("bigint")).alias("labels"))), "t", "me")
        with pytest.raises(ContractError, match="not a detection"):
            outputs.DETECTION.check(r.put("t", r["x"]), "t", "me")
        assert outputs.SEGMENTATION.check(r.put("p_mask", F.array(r["id"])), "p", "me").entries["p_mask"]
        with pytest.raises(ContractError, match="'logits' of segmentation"):
            outputs.SEGMENTATION.check(r.put_all({"p_mask": F.array(r["id"]), "p_logits": r["v"]}), "p", "me")

    def test_chains(self, spark):
        check_chain([MODELS["ModelPredict"], ClassificationPredictions()], ["v"])
        with pytest.raises(ChainError, match="ModelPredict.*reads"):
            check_chain([MODELS["ModelPredict"]], ["x"])
        with pytest.raises(ChainError, match="ClassificationPredictions.*reads.*'probs'"):
            check_chain([MODELS["ModelSegment"], ClassificationPredictions()], ["v"])
        with pytest.raises(ChainError, match="takes 'probs' of a classification, but operator 0 .* delivers it as a restoration"):
            check_chain([ModelRestore(model, "v", "probs"), ClassificationPredictions()], ["v", "class_idx"])
        with pytest.raises(ContractError, match="no entry 'probs' of a classification"):
            ClassificationPredictions()(numbers(spark))

    def test_boxes_that_differ_in_number(self, spark):
        bad = ModelDetect(lambda: lambda x: [{"boxes": [[0, 0, 1, 1]], "scores": [], "labels": [1]} for _ in x], "v", (1, 1))
        with pytest.raises(Exception, match="differ in number"):
            bad(numbers(spark)).result().collect()

    def test_builders_on_odd_values(self, spark):
        frame = spark.createDataFrame([(None, None), ([2.0, 2.0], [[1.0, 5.0], [1.0, 6.0]]), ([3.0], [[]])], "l array<double>, p array<array<double>>")
        rows = frame.select(outputs.classification_output(F.col("l")).alias("c"), outputs.segmentation_output(F.col("p")).alias("s"), outputs.restoration_output(F.col("l")).alias("r")).collect()
        assert rows[0].c is None and rows[0].s is None and rows[0].r is None
        assert rows[1].c.class_idx == 0 and rows[1].c.probs == [0.5, 0.5] and rows[1].s.mask == [0, 1] and rows[1].r.image == [2.0, 2.0]
        assert abs(rows[1].s.probs[0][0] - 0.5) < 1e-12 and rows[2].s.mask == [] and rows[2].c.probs == [1.0]
