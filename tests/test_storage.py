"""Late filters, chunked arrays, batch stores, committed ranges and tensors: what is read, what is refused, odd values."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions import tensors
from recordloom.operators.structure import SelectFields
from recordloom.plans.process import Processor
from recordloom.plans.record import records
from recordloom.sources.batches import BatchStore
from recordloom.sources.chunks import ArrayStore
from recordloom.sources.late import key_ranges, late_filter
from recordloom.sources.store import CommittedStore


@pytest.fixture()
def place(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def scanned(frame) -> dict[str, int]:
    """Rows and files that the scans of a frame gave, after it was run."""
    frame.write.format("noop").mode("overwrite").save()
    execution = frame._jdf.queryExecution()
    frame.collect()
    plan, found = execution.executedPlan(), {"numOutputRows": 0, "numFiles": 0}
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            for name in found:
                found[name] += node.metrics().apply(name).value()
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return found


def wide(spark, place, n=40_000, files=8):
    rows = spark.range(0, n, 1, files).select(F.col("id").alias("key"), (F.col("id") % 7).alias("light"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("payload"))
    rows.write.option("parquet.page.row.count.limit", 500).parquet(place)
    return rows


class TestLateFilter:
    def test_reads_what_is_kept(self, spark, place):
        wide(spark, place)
        for where, share in (("key >= 10000 and key < 12000 and light == 3", 0.06), ("key < 20000", 0.51), ("key >= 39990", 0.02)):
            r = late_filter(spark, place, where, key="key")
            frame = SelectFields(["key", "payload"])(r).result()
            seen = scanned(frame)
            want = spark.read.parquet(place).filter(where.replace("==", "=")).count()
            assert frame.count() == want > 0
            assert seen["numOutputRows"] <= share * 40_000 + 500

    def test_matches_at_both_ends_of_a_file(self, spark, place):
        """A gap inside one file, told by the key: its pages are skipped though its row group is not."""
        wide(spark, place, 20_000, 1)
        near = F.col("payload").isNotNull() & ((F.col("key") < 100) | (F.col("key") > 19_900))
        r = late_filter(spark, place, predicate=near, key="key")
        assert scanned(r.result())["numOutputRows"] <= 2_000 and r.frame.count() == 199

    def test_positions_without_a_key(self, spark, place):
        wide(spark, place)
        r = late_filter(spark, place, "light == 2 and key > 35000")
        rows = r.result(position="_idx").collect()
        everything = records(spark.read.parquet(place)).result(position="_idx")
        assert sorted((x["_idx"], x.key) for x in rows) == sorted((x["_idx"], x.key) for x in everything.filter("light = 2 and key > 35000").collect())
        assert scanned(SelectFields(["payload"])(r).result())["numFiles"] <= 2

    def test_odd_tables(self, spark, place):
        spark.createDataFrame([(None, 1, "a b"), (5, 1, None), (7, None, "x"), (5, 1, "y")], "key bigint, light int, `pay load` string").write.parquet(f"{place} with blanks")
        r = late_filter(spark, f"{place} with blanks", "light == 1", key="key")
        assert sorted(map(str, r.result().collect())) == sorted(map(str, spark.read.parquet(f"{place} with blanks").filter("light = 1").collect()))
        assert late_filter(spark, f"{place} with blanks", "light == 9", key="key").result().collect() == []
        assert late_filter(spark, f"{place} with blanks", "light == 9").result().columns == ["key", "light", "pay load"]
        with pytest.raises(ValueError, match="whole numbers"):
            late_filter(spark, f"{place} with blanks", "light == 1", key="pay load")
        with pytest.raises(ValueError, match="expression"):
            late_filter(spark, place)

    def test_ranges(self, spark):
        keys = spark.createDataFrame([(k,) for k in (0, 1, 2, 50, 51, 99, -(2**62), 2**62)], "k bigint")
        small = keys.filter("abs(k) < 100")
        assert key_ranges(small, "k", 0, 99, 100, 64) == [(0, 2), (50, 51), (99, 99)]
        assert key_ranges(small, "k", 0, 99, 100, 2) in ([(0, 51), (99, 99)], [(0, 2), (50, 99)])
        assert key_ranges(small, "k", 0, 99, 100, 1) == [(0, 99)]
        found = key_ranges(keys, "k", -(2**62), 2**62)
        assert all(any(a <= r.k <= b for a, b in found) for r in keys.collect()) and len(found) == 3


class TestArrayStore:
    ROWS = [(0, list(range(10)), "a"), (1, [], "b"), (2, None, None), (3, [7], "d"), (4, list(range(100)), "e"), (5, [None, 2, None], "f"), (6, list(range(16)), "g")]

    @pytest.mark.parametrize("chunk", [4, 16, 1000])
    def test_every_slice(self, spark, place, chunk):
        store = ArrayStore(place, chunk)
        store.write(records(spark.createDataFrame(self.ROWS, "n bigint, x array<int>, s string"), "n"))
        ends = [None, 0, 1, 3, 4, 9, 16, 200, -1, -4, -5, -16, -200]
        for start, stop, step in [(a, b, 1 + (k % 3)) for k, (a, b) in enumerate((a, b) for a in ends for b in ends)][:: 3 if chunk == 4 else 11]:
            cut = slice(start, stop, step)
            got = {r["_idx"]: r["value"] for r in store.read_slice(spark, "x", cut).collect()}
            assert got == {n: None if x is None else x[cut] for n, x, _ in self.ROWS}, cut
        some = store.read_slice(spark, "x", slice(2, 8), [4, 2, 0]).collect()
        assert sorted((r["_idx"], r["value"]) for r in some) == [(0, list(range(2, 8))), (2, None), (4, list(range(2, 8)))]

    def test_whole_records(self, spark, place):
        frame = spark.createDataFrame([(9, [[1, 2], [3]], {"v": 1.0}, [{"t": "x"}]), (8, None, None, [])], "n bigint, x array<array<int>>, m struct<v:double>, y array<struct<t:string>>")
        store = ArrayStore(place, 1)
        store.write(records(frame, "n", {"x": "Image"}))
        back = store.read(spark)
        assert back.kinds == {"x": "Image"} and list(back.entries) == frame.columns
        assert sorted(map(str, back.result().collect())) == sorted(map(str, frame.collect()))
        assert store.read(spark, {"x": slice(0, 1)}).result().filter("n = 9").first().x == [[1, 2]]
        with pytest.raises(KeyError, match="no array 'm'"):
            store.read(spark, {"m": slice(1)})
        with pytest.raises(ValueError, match="step"):
            store.read_slice(spark, "x", slice(0, 5, -1))
        frame.select(F.col("n").alias("_idx"), "m").write.parquet(f"{place}-other/records")
        with pytest.raises(ValueError, match="does not hold"):
            ArrayStore(f"{place}-other").read(spark)

    def test_a_slice_reads_its_chunks(self, spark, place):
        rows = spark.range(0, 200, 1, 2).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(6399)), lambda k: k + F.col("id")).alias("x"))
        store = ArrayStore(place, 64)
        store.write(records(rows, "id"))
        chunks = spark.read.parquet(f"{place}/arrays/x").count()
        assert chunks == 200 * 100
        for cut, most in ((slice(640, 704), 0.03), (slice(-100, -50), 0.05), (slice(0, 640), 0.13), (slice(None), 1.0)):
            frame = store.read_slice(spark, "x", cut)
            seen = scanned(frame)["numOutputRows"] - 200
            assert seen <= most * chunks + 200
            assert frame.filter("_idx = 7").first().value == [k + 7 for k in range(6400)][cut]


class TestBatchStore:
    def records(self, spark, low, high):
        return records(spark.range(low, high).select(F.col("id"), F.array(F.col("id"), -F.col("id")).alias("x"), F.lit("t").alias("s")), "id")

    def test_appends_and_reads(self, spark, place):
        store = BatchStore(place, 4)
        assert len(store) == 0
        totals = [store.append(self.records(spark, a, b)) for a, b in ((0, 6), (6, 6), (6, 7), (7, 8), (8, 21), (21, 22))]
        assert totals == [6, 6, 7, 8, 21, 22] and len(store) == 22
        assert [(r["_idx"], r.id, r.x) for r in store.read(spark).result(position="_idx").orderBy("_idx").collect()] == [(k, k, [k, -k]) for k in range(22)]
        sizes = [len(r.id) for r in store.batches(spark).orderBy("batch_id").collect()]
        assert sizes == [4, 4, 4, 4, 4, 2]
        assert sorted((r["_idx"], r.x) for r in store.at(spark, [21, 3, -22]).collect()) == [(0, [0, 0]), (3, [3, -3]), (21, [21, -21])]
        with pytest.raises(IndexError):
            store.at(spark, [22])

    def test_one_record_reads_one_batch(self, spark, place):
        store = BatchStore(place, 50)
        store.append(self.records(spark, 0, 5000))
        frame = store.at(spark, [1234])
        assert frame.first().id == 1234 and scanned(frame)["numOutputRows"] <= 2

    def test_an_append_that_failed_leaves_nothing(self, spark, place):
        store = BatchStore(place, 4)
        store.append(self.records(spark, 0, 6))
        # what an append writes before it is told in the table of appends
        store.batches(spark).limit(1).write.parquet(f"{place}/batches/1")
        assert store.read(spark).frame.count() == 6
        assert store.append(self.records(spark, 6, 9)) == 9
        assert sorted(r.id for r in store.read(spark).result().collect()) == list(range(9))

    def test_refusals(self, spark, place):
        store = BatchStore(place, 4)
        store.append(self.records(spark, 0, 6))
        other = records(spark.createDataFrame([(1, [1, 2, 3], "s")], "id bigint, x array<bigint>, s string"), "id")
        with pytest.raises(ValueError, match="x has shapes"):
            store.append(other)
        ragged = records(spark.createDataFrame([(1, [1, 2], "s"), (2, [1], "s")], "id bigint, x array<bigint>, s string"), "id")
        with pytest.raises(ValueError, match="x has shapes"):
            store.append(ragged)
        with pytest.raises(ValueError, match="the store holds"):
            store.append(records(spark.createDataFrame([(1, 2)], "id bigint, y int"), "id"))
        with pytest.raises(ValueError, match="batches of 4"):
            BatchStore(place, 5).append(self.records(spark, 6, 7))
        with pytest.raises(ValueError, match="holds no batches"):
            BatchStore(f"{place}-none").read(spark)
        assert len(store) == 6


class TestCommittedRanges:
    def source(self, spark, n=40):
        return records(spark.range(n).select("id", (F.col("id") * 2).alias("twice")), "id")

    def test_holes_and_failures(self, spark, place):
        store, source = CommittedStore(place), self.source(spark)
        assert store.missing(spark, 0, 10) == [(0, 10)] and store.resume_position(spark) == 0 and store.failed(spark) == []
        assert Processor(source, [], store, 10, 15).run_missing(spark) == [(10, 15)]
        assert Processor(source, [], store, 20, 25).run_missing(spark, 3) == [(20, 23), (23, 25)]
        broken = [lambda r: r.filter(F.when(r["id"] == 7, F.raise_error(F.lit("seven"))).isNull())]
        with pytest.raises(PySparkException, match="seven"):
            Processor(source, broken, store).run_missing(spark, 4)
        assert store.committed(spark) == [(0, 4), (10, 15), (20, 25)] and store.resume_position(spark) == 4
        assert [(a, b) for _, a, b in store.failed(spark)] == [(4, 8)]
        # the failed attempt is not read, and a rerun fills every hole once
        assert {r.id for r in store.read(spark).result().collect()} == {*range(4), *range(10, 15), *range(20, 25)}
        assert Processor(source, [], store).run_missing(spark, 100) == [(4, 10), (15, 20), (25, 40)]
        assert sorted(r.id for r in store.read(spark).result().collect()) == list(range(40))
        assert Processor(source, [], store).run_missing(spark) == [] and store.committed(spark) == [(0, 40)]
        assert [(a, b) for _, a, b in store.failed(spark)] == [(4, 8)]

    def test_refusals(self, spark, place):
        store, source = CommittedStore(place), self.source(spark)
        store.write_range(source.filter(source["id"] < 5), 0, 5)
        for low, high in ((3, 9), (5, 5), (0, 5)):
            with pytest.raises(ValueError, match="committed"):
                store.write_range(source, low, high)
        with pytest.raises(TypeError, match="list"):
            Processor(source, [], []).run_missing(spark)
        with pytest.raises(ValueError, match="no part"):
            CommittedStore(f"{place}-none").read(spark)
        empty = self.source(spark, 0)
        assert Processor(empty, [], CommittedStore(f"{place}-empty")).run_missing(spark) == []


class TestTensors:
    def frame(self, spark, rows, kind="array<array<int>>"):
        frame = spark.createDataFrame(rows, f"b int, k int, x {kind}")
        return frame.withColumn("t", tensors.tensor(F.col("x"), frame.schema["x"].dataType, "x"))

    def test_round_trip(self, spark):
        rows = [(0, 1, [[1, 2, 3], [4, 5, 6]]), (0, 0, [[7, 8, 9], [10, 11, None]]), (1, 0, [[0, 0, 0], [1, 1, 1]])]
        frame = self.frame(spark, rows)
        assert all(r.y == r.x for r in frame.select("x", tensors.nested(F.col("t"), 2).alias("y")).collect())
        whole = tensors.stacked_tensors(frame, "t", "b", "k")
        first = whole.filter("b = 0").first().t
        assert list(first.shape) == [2, 2, 3] and first.dtype == "int" and first.data == [7, 8, 9, 10, 11, None, 1, 2, 3, 4, 5, 6]
        back = tensors.unstacked_tensors(whole, "t", "b").select("b", "place", tensors.nested(F.col("t"), 2).alias("x"))
        assert sorted(map(tuple, back.collect())) == sorted(rows)
        turned = frame.select("b", "k", tensors.transposed(F.col("t"), [1, 0]).alias("t")).select("b", "k", tensors.nested(F.col("t"), 2).alias("x"))
        assert {(r.b, r.k): r.x for r in turned.collect()} == {(b, k): [list(c) for c in zip(*x)] for b, k, x in rows}

    def test_odd_values(self, spark):
        frame = self.frame(spark, [(0, 0, []), (0, 1, None), (1, 0, [[], []])])
        assert [r.t and list(r.t.shape) for r in frame.orderBy("b", "k").collect()] == [[0, 0], None, [2, 0]]
        assert [r.y for r in frame.orderBy("b", "k").select(tensors.nested(F.col("t"), 2).alias("y")).collect()][0] == []
        for rows, text in (([(0, 0, [[1], [2, 3]])], "x is ragged"), ([(0, 0, [[1]]), (0, 1, [[1, 2]])], "t cannot be stacked"), ([(0, 0, [[1]]), (0, 1, None)], "nulls: 1")):
            with pytest.raises(PySparkException, match=text):
                tensors.stacked_tensors(self.frame(spark, rows), "t", "b", "k").collect()
        with pytest.raises(TypeError, match="no array"):
            tensors.tensor(F.col("b"), frame.schema["b"].dataType, "b")
        with pytest.raises(ValueError, match="order of axes"):
            tensors.transposed(F.col("t"), [0, 0])

    def test_shapes_are_told_by_partial_aggregates(self, spark):
        frame = self.frame(spark, [(0, 0, [[1]])])
        plan = tensors.stacked_tensors(frame, "t", "b", "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("partial_min") == 1 and plan.count("partial_max") == 1
