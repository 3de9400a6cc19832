"""Operators on tiny literal records: refusals, edges, and parity of spellings and partitionings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import arrays as A
from recordloom.functions import boxes as B
from recordloom.functions import images as I
from recordloom.functions import draws, quantity
from recordloom.functions.expressions import ExpressionError, translate
from recordloom.operators import labels as L
from recordloom.operators.arrays import Threshold, ToType
from recordloom.operators.algorithm import Algorithm, Input, Output, Param, algorithm_spec
from recordloom.operators.collate import batch_metadata, batch_values, collate, per_record_predictions, register_collate, registered_collates, stacked
from recordloom.operators.contract import ChainError, ClassNames, ContractError, GraphContract, RecordContract, check_chain, flag_producers
from recordloom.operators.control import Enable, Pipeline, RandomApply
from recordloom.operators.debug import PrintRecord
from recordloom.operators.detection import ConvertFromBoxes, ConvertToBoxes
from recordloom.operators.predict import ModelDetect, ModelPredict, ModelSegment
from recordloom.operators.regions import components, greedy_matches, overlaps, stack_components
from recordloom.operators.structure import CopyField, DropField, Formula, PutField, RandomNumber, RenameField, SelectFields, Where, WiredEntries
from recordloom.plans.process import trace
from recordloom.plans.record import Flow, Step, StepReferenceError, Stream, records
from recordloom.sources import files, views
from recordloom.sources.datasets import dataset
from recordloom.sources.metadata import dataset_uri, dataset_uris, record_metadata
from recordloom.sources.order import with_rank
from recordloom.sources.store import DirectoryStore, ParquetStore


@pytest.fixture(scope="module")
def small(spark):
    rows = [(k, f"d/{n}", x, [float(k), float("nan"), -1.0]) for k, (n, x) in enumerate([("a.txt", 1), ("b.txt", 2), ("a.csv", None), ("c", 4), ("b.txt", 5)])]
    return records(spark.createDataFrame(rows, "id bigint, file string, x int, a array<double>"), "id")


def values(r, key):
    return [row[key] for row in r.result(ordered=True).collect()]


def test_structure(small):
    assert list(RenameField("file", "x")(small).entries) == ["id", "x", "a"]
    assert list(RenameField("x", "file")(small).entries) == ["id", "file", "a"]
    assert values(RenameField("x", "file")(small), "file") == [1, 2, None, 4, 5]
    assert list(SelectFields(["x", "id"])(small).entries) == ["x", "id"]
    assert list(WiredEntries({"x": "id", "id": "x"})(small).entries) == ["file", "a", "x", "id"]
    assert values(CopyField("id", "x")(small), "x") == [0, 1, 2, 3, 4]
    assert [v["value"] for v in values(PutField("p", 3)(small), "p")] == [3] * 5
    for bad, error in ((lambda: RenameField("no", "y")(small), KeyError), (lambda: RenameField("", "y")(small), ValueError), (lambda: SelectFields([])(small), ValueError), (lambda: SelectFields(["no"])(small), KeyError), (lambda: DropField("no")(small), KeyError), (lambda: PutField("p", None)(small), ValueError)):
        with pytest.raises(error):
            bad()
    assert DropField("no", missing_ok=True)(small) is not None


def test_where_and_formula(spark, small):
    assert values(Where("x > 1 and x.value < 5")(small), "id") == [1, 3]
    assert values(Where("gone > 1")(small), "id") == [] and values(Where("x is None")(small), "id") == [2]
    one = spark.range(1)
    for text, want in (("7 % 3", 1), ("-7 % 3", 2), ("7 // 2", 3), ("round(2.5)", 2), ("round(3.5)", 4), ("2 ** 3", 8), ("max(1, 2, 3)", 3), ("math.pi", math.pi), ("1 if 2 > 3 else 0", 0), ("1 < 2 < 3", True), ("'a' in ['a', 'b']", True), ("math.trunc(-1.5)", -1)):
        assert one.select(translate(text, lambda n: F.lit(None)).alias("v")).first().v == want, text
    for text in ("__import__('os')", "x.__class__", "[1][0]", "lambda: 1", "1 +", "open('f')"):
        with pytest.raises(ExpressionError):
            translate(text, lambda n: F.lit(1))
    assert values(Formula("x * 2 + id", "x")(small), "x") == [2, 5, None, 11, 14]


def test_arrays(spark, small):
    assert values(Threshold("a", low_level=0.5)(small), "mask")[1] == [True, False, False]
    with pytest.raises(ValueError, match="bound"):
        Threshold("a")(small)
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        Threshold("a", low_level=float("nan"))(small)
    with pytest.raises(Exception, match="does not fit"):
        ToType("a", "uint8")(small).result().collect()
    row = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],), ([],), ([5.0, 5.0],), ([float("nan"), 1.0, float("inf")],)], "a array<double>")
    got = row.select(A.median(F.col("a")).alias("m"), A.std(F.col("a")).alias("s"), A.to_uint8(F.col("a")).alias("u"), A.argmax(F.col("a")).alias("g"), A.top_k(F.col("a"), 2).alias("t")).collect()
    assert got[0].m == 2.5 and abs(got[0].s - np.std([1, 2, 3, 4])) < 1e-12 and got[0].u == [170, 0, 85, 255] and got[0].g == 3
    assert [t.idx for t in got[0].t] == [3, 0] and got[1].m is None and got[2].u == [0, 0] and got[2].g == 0 and got[2].m == 5


def test_views(spark, small):
    assert values(views.range_view(small, 1, -1), "id") == [1, 2, 3] and values(views.range_view(small, -2), "id") == [3, 4]
    assert values(views.range_view(small, 4, 2), "id") == [] and values(views.range_view(small, 0, 99), "id") == [0, 1, 2, 3, 4]
    both = views.concat_view(SelectFields(["id", "x"])(small), SelectFields(["file"])(small))
    assert both.result(ordered=True, position="p").select("p").collect() == [(k,) for k in range(10)] and values(both, "x")[5:] == [None] * 5
    other = records(spark.createDataFrame([(0, "q/b.txt"), (1, "a.doc")], "id bigint, file string"), "id")
    assert values(views.difference_view(small, other, "file"), "id") == [0, 1, 2, 3, 4]
    assert values(views.difference_view(small, other, "file", "name"), "id") == [0, 2, 3]
    assert values(views.difference_view(small, other, "file", "stem"), "id") == [3]
    with pytest.raises(ValueError):
        views.filter_view(small)
    assert views.split_counts(10, 0.25, 0.05) == (7, 2, 1) and views.split_counts(3, 0.5, 0.4) == (0, 2, 1)
    many = records(spark.range(1001), "id")
    parts = [views.split_view(many, p, 0.1, 0.2, 7).result().collect() for p in ("train", "val", "test")]
    assert [len(p) for p in parts] == list(views.split_counts(1001, 0.1, 0.2)) and len({r.id for p in parts for r in p}) == 1001
    with pytest.raises(ValueError, match="seed"):
        views.split_view(many, "train", 0.1)
    assert views.at_positions(small, [4, 0, 4], ["id"]).orderBy("pos").collect() == [(0, 4), (1, 0), (2, 4)]
    assert views.first_value(small, "x").first().x == 1
    ranked = with_rank(spark.range(500).repartition(7), "rank", F.col("id").desc())
    assert all(r.rank == 499 - r.id for r in ranked.collect())


def test_same_draws_for_any_partitioning(spark):
    one, many = (records(spark.range(300).repartition(n), "id") for n in (1, 8))
    op = RandomApply(Pipeline([RandomNumber("u", 0, 1, 4), Formula("x + 1", "id", output="more")]), 0.4, 9)
    got = [sorted(map(str, op(r).result().collect())) for r in (one, many)]
    assert got[0] == got[1] and 60 < sum("None" not in x for x in got[0]) < 180


def test_flow(spark, small):
    steps = (Step("a", Formula("x * 10", "x")), Step("b", Formula("x * 100", "x", output="y"), reads="source"), Step("m", merges=("a",), reads="b"), Step("cut", Where("id != 0"), reads="source"), Step("out", SelectFields(["x", "y"]), reads="m"))
    rows = Flow(small, steps).result(ordered=True).collect()
    assert [(r.x, r.y) for r in rows] == [(20, 200), (None, None), (40, 400), (50, 500)]  # a drop on a side branch holds
    fluent = Stream(small).then(Formula("x * 10", "x")).filter("id != 0").result(ordered=True).collect()
    assert [r.x for r in fluent] == [r.x for r in rows]
    for bad in ((Step("a", reads="later"), Step("later")), (Step("a"), Step("a")), (Step("x.y"),), (Step("a", bind={"p": "source[x]"}),)):
        with pytest.raises(StepReferenceError):
            Flow(small, bad).record()
    bound = Flow(small, (Step("low", Formula("id - 0.5", "id", output="l")), Step("t", Threshold("a"), reads="source", bind={"low_level": "low[l]"})))
    assert values(bound.record(), "mask")[2] == [True, False, False]
    seen = trace(Flow(small, steps), 0)
    assert seen["a"]["x"] == 10 and seen["cut"] is None
    assert values(Enable([DropField("x")], enabled=False)(small), "x")[0] == 1
    with pytest.raises(TypeError):
        Enable([DropField("x")], enabled=1)(small)


def test_unused_entries_are_pruned(spark, sf_dir):
    r = records(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    plan = Stream(r).map("text", F.upper).filter("n_chars > 10").project(["lang"])._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in read and "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,10)]" in plan


def test_labels(spark):
    names = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "n string")
    m = L.LabelMap.fit(names)
    assert m.ids == {"a": 0, "b": 1} and L.LabelMap.load(m.save()) == m and L.LabelMap({"z": 3}).class_names == ["0", "1", "2", "z"]
    many = spark.createDataFrame([(["x", "y"],), ([],), (["y"],)], "n array<string>")
    assert L.LabelMap.fit(many).ids == {"x": 0, "y": 1}
    with pytest.raises(ValueError):
        L.LabelMap.fit(names.limit(0))
    with pytest.raises(Exception, match="unknown class"):
        names.select(L.LabelMap({"a": 0}).encode(F.col("n"))).collect()
    counts = L.class_counts(spark.createDataFrame([(0,), (0,), (0,), (1,), (None,), (9,)], "i int"), 3)
    assert sorted(counts.collect()) == [(0, 3.0), (1, 1.0), (2, 0.0)]
    assert sorted(map(tuple, L.inverse_frequency_weights(counts).collect())) == [(0, 4 / 9), (1, 4 / 3), (2, 0.0)]
    for bad in ([(None,)], [], [(1.5,)]):
        with pytest.raises(Exception):
            L.num_classes(spark.createDataFrame(bad, "i double")).collect()
    assert L.histogram(spark.createDataFrame([([1.0, 1.0, float("nan")],)], "a array<double>"), 2).orderBy("bin").collect() == [(0, 0), (1, 2)]
    assert [r["count"] for r in L.histogram(spark.createDataFrame([], "a array<double>"), 2).collect()] == [0, 0]


def test_boxes_and_regions(spark):
    row = spark.range(1).select(B.box(*[F.lit(v) for v in (0, 0, 2, 2)]).alias("a"), B.box(*[F.lit(v) for v in (1, 1, 3, 3)]).alias("b"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(1.0)).alias("n"))
    got = row.select(B.iou(F.col("a"), F.col("b")).alias("i"), B.to_numbers(B.from_numbers(F.col("n"), "cxcywh", F.lit(8.0), F.lit(4.0))).alias("s"), B.size_bucket(F.col("a")).alias("z"), B.coco_to_detection(F.struct(F.lit(None).cast("array<array<double>>").alias("bbox"), F.lit(None).cast("array<int>").alias("category"))).alias("c")).first()
    assert abs(got.i - 1 / 7) < 1e-12 and got.s == [0.0, 0.0, 4.0, 4.0] and got.z == "small" and got.c.boxes == [] and got.c.labels == []
    mask = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 1]], bool)
    assert components(mask) == [(0, 0, 1, 1), (2, 0, 3, 1), (1, 1, 2, 2), (2, 2, 3, 3)] and components(mask, 8) == [(0, 0, 3, 3)] and components(mask, 4, 2) == []
    assert greedy_matches(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.5) == [(0, 0)] and greedy_matches(np.zeros((0, 0)), 0.5) == []


def test_images(spark):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert I.converted(a, "RGBA").shape == (2, 4, 4) and I.converted(a, "L").shape == (2, 4) and (I.resized(a, 4, 2) == a).all()
    assert I.padded(a, 3, 5, 9)[2, 4].tolist() == [9, 9, 9] and I.stitched([a, a, a], "grid", 1).shape == (5, 9, 3)
    assert I.fitted_size(10, 20, 0, 0, 10) == (5, 10) and I.fitted_size(10, 20, 40, 0) == (20, 40) and I.fitted_size(10, 20, None, None) == (10, 20)
    with pytest.raises(ValueError):
        I.fitted_size(1, 1, None, 0)
    ppm = b"P6 # c\n4 2\n255\n" + a.tobytes()
    rows = spark.createDataFrame([(bytearray(ppm),), (bytearray(b"junk"),), (None,)], "content binary").select(I.decode(F.col("content")).alias("i")).collect()
    assert rows[0].i.height == 2 and bytes(rows[0].i.data) == a.tobytes() and all(r.i is None or r.i.height is None for r in rows[1:])


def test_batches_contracts_quantities(spark, small):
    batch = collate(SelectFields(["id", "x"])(small), 2).orderBy("batch_id").collect()
    assert [b.id for b in batch] == [[0, 1], [2, 3], [4]] and batch[1].x == [None, 4]
    ragged = collate(records(spark.createDataFrame([(0, [1]), (1, [1, 2])], "id bigint, v array<int>"), "id"), 2)
    with pytest.raises(Exception, match="cannot be stacked"):
        stacked(ragged, "v").collect()
    with pytest.raises(ContractError):
        RecordContract({"no": "*"})(small)
    with pytest.raises(ContractError):
        RecordContract({"x": "Label"})(small)
    with pytest.raises(Exception, match="x is null in record 2"):
        RecordContract({"x": "*"})(small).result().collect()

    class Reads:
        consumes, produces = ("y",), ("z",)

    check_chain([Reads()], ["y"])
    with pytest.raises(ContractError):
        check_chain([Reads()], ["x"])
    texts = spark.createDataFrame([("2.5 MSa/s",), ("3 ms",), ("10Hz",)], "t string")
    assert [r.v for r in texts.select(quantity.parse(F.col("t")).alias("v")).collect()] == [2.5e6, 3e-3, 10.0]
    with pytest.raises(Exception, match="not a quantity"):
        spark.createDataFrame([("10 kg",)], "t string").select(quantity.parse(F.col("t"))).collect()


def test_stores_and_files(spark, small, tmp_path):
    store = ParquetStore(str(tmp_path / "p"))
    assert store.resume_position(spark) == 0
    store.write(Threshold("a", low_level=0)(small))
    back = store.read(spark)
    assert list(back.entries) == ["id", "file", "x", "a", "mask"] and back.kinds["mask"] == "Mask" and store.resume_position(spark) == 5
    spark.range(2).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="does not hold"):
        ParquetStore(str(tmp_path / "plain")).read(spark)
    folders = DirectoryStore(str(tmp_path / "d"))
    folders.write(SelectFields(["file", "x", "a"])(small))
    again = folders.read(spark, "file string, x int, a array<double>").result(ordered=True).collect()
    assert [r.file for r in again] == ["d/a.txt", "d/b.txt", "d/a.csv", "d/c", "d/b.txt"] and again[3].a[0] == 3.0 and again[2].x is None
    for name in ("f1/x.json", "f1/y.json", "f1/z.json", "f2/x.json", "f3/deep/x.json", "top.json", ".hidden", "f1/x.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    root = str(tmp_path / "t")
    assert files.files(spark, root, pattern="*.json").result().count() == 6
    assert files.files(spark, root, pattern="f1/*", exclude=["*.txt"]).result().count() == 3
    listed = files.listing(spark, root, "*.json").withColumn("set", F.lit("A"))
    assert files.select_files(listed, max_depth=1).count() == 5
    assert files.select_files(listed, max_files_per_folder=2).count() == 5
    assert sorted(r.relative for r in files.select_files(listed, max_subfolders=1).collect()) == ["f1/x.json", "f1/y.json", "f1/z.json", "top.json"]
    assert files.select_files(listed, max_folders=2).count() == 4 and files.select_files(listed, max_files=1).count() == 1
    with pytest.raises(ValueError):
        files.files(spark, root, pattern="*.none")
    with pytest.raises(ValueError):
        files.files(spark)
    with pytest.raises(ValueError, match="no columns"):
        dataset(spark.range(3), "id", "image")


def test_row_order_of_several_files(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    r = records(spark.read.parquet(str(tmp_path / "many")))
    assert sorted(x.p for x in r.result(position="p").select("p").collect()) == list(range(12))


def test_formats_channels_masks_and_taps(spark, small, tmp_path):
    import json

    from recordloom.operators.images import ConvertToMask, ReadImage, SelectChannel
    from recordloom.operators.transforms import Flip, Tap

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text('{"v": 3}')
    (tmp_path / "f" / "b.pgm").write_bytes(b"P5 2 1 255\n" + bytes([4, 9]))
    files.register_format("doc", ".json", "v: int", lambda b: json.loads(b))
    files.register_format("grey", ".pgm", "n: int", lambda b: {"n": len(b)})
    table = files.listing(spark, str(tmp_path / "f"), contents=True)
    got = {r.file[-6:]: r for r in files.read_files(table, ["doc", "grey"]).collect()}
    assert got["a.json"].doc.v == 3 and got["a.json"].grey is None and got["/b.pgm"].grey.n == 13 and got["/b.pgm"].doc is None
    with pytest.raises(Exception, match="not one of the formats"):
        files.read_files(table, ["doc"]).collect()
    r = ReadImage("content")(records(table.withColumn("at", F.lit(0)), "at"))
    masks = [x for x in values(ConvertToMask("image")(r), "mask") if x is not None]
    assert masks == [[4, 9]]
    assert [bytes(x.data) for x in values(SelectChannel("image", -1)(r), "image") if x is not None] == [bytes([4, 9])]
    store = ParquetStore(str(tmp_path / "tap"))
    assert values(Tap(store)(SelectFields(["id"])(small)), "id") == values(store.read(spark), "id") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="no kernel"):
        Flip("x")(small)


def test_components_of_many_masks_and_matches():
    rng = np.random.default_rng(4)
    masks = rng.random((40, 9, 7)) < 0.5

    def by_hand(mask, connectivity):
        left, out = set(zip(*np.nonzero(mask))), []
        for cell in sorted(left):
            if cell in left:
                front, seen = [cell], {cell}
                while front:
                    y, x = front.pop()
                    near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or not (a and b)}
                    front += (near & left) - seen
                    seen |= near & left
                left -= seen
                ys, xs = zip(*seen)
                out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        return out

    for connectivity in (4, 8):
        assert stack_components(masks, connectivity) == [by_hand(m, connectivity) for m in masks]
    assert stack_components(np.zeros((2, 3, 3), bool)) == [[], []]
    iou = overlaps(np.array([[0, 0, 2, 2], [5, 5, 5, 5.0]]), np.array([[1, 0, 3, 2.0]]))
    assert iou.tolist() == [[1 / 3], [0.0]] and greedy_matches(iou, 0.3) == [(0, 0)] and greedy_matches(iou, 0.5) == []


def test_quantities_and_grids(spark):
    texts = spark.createDataFrame([("250",), ("1e6",), ("100 k",), ("2. MHz",), (".5",), ("-3 ms",), (None,)], "t string")
    assert [r.v for r in texts.select(quantity.parse(F.col("t")).alias("v")).collect()] == [250.0, 1e6, 1e5, 2e6, 0.5, -3e-3, None]
    assert [r.v for r in texts.select(quantity.unit(F.col("t")).alias("v")).collect()] == [None, None, None, "Hz", None, "s", None]
    with pytest.raises(Exception, match="not in Hz"):
        texts.select(quantity.of_kind(F.col("t"), "frequency")).collect()
    assert draws.grid_points(0.1, 0.35, 0.1) == [0.1, 0.2, 0.3]
    assert draws.grid_points(100, 1000, 100, "power", ratio=2) == [100, 200, 400, 800]
    with pytest.raises(ValueError, match="low above 0"):
        draws.grid_points(0, 1, 0.1, "log")
    with pytest.raises(Exception, match="refused: too small"):
        spark.range(1).select(draws.first_accepted(lambda k: k, lambda x: x < 0, 3, "too small")).collect()


def test_splits_by_counting(spark):
    frame = spark.range(5000).select((F.col("id") * F.col("id") * 7919 % (1 << 60)).alias("code"))
    codes = sorted(r.code for r in frame.collect())
    rows, bounds = views.boundaries(frame, "code", lambda n: [0, n // 3, n - 1, n])
    assert rows == 5000 and [sum(c < b for c in codes) for b in bounds] == [0, 1666, 4999, 5000]
    assert views.boundaries(frame.limit(0), "code", lambda n: [n, n]) == (0, [0, 0])


def test_box_operators_refuse(spark):
    r = records(spark.createDataFrame([(1, [[0.0, 0.0, 2.0, 4.0]])], "id bigint, rows array<array<double>>"), "id")
    out = ConvertToBoxes(format="xywh")(r)
    back = ConvertFromBoxes(format="cxcywh", container="array", output="c")(out)
    assert back.result().first().c == [[1.0, 2.0, 2.0, 4.0]]
    with pytest.raises(ValueError, match="holds no boxes"):
        ConvertToBoxes("id")(r)
    with pytest.raises(ValueError, match="size"):
        ConvertToBoxes(normalized=True)
    with pytest.raises(Exception, match="without a canvas"):
        ConvertFromBoxes(normalized=True)(out).result().collect()


def test_chains_and_graphs(small):
    class Op:
        def __init__(self, **declared):
            self.__dict__.update(declared)

    bright, dim = Op(flags=("bright",), reports="light"), Op(requires="bright", reports="dark")
    check_chain([bright, dim])
    check_chain([dim], raised=["bright"])
    assert flag_producers([dim, bright]) == {"bright": 1}
    for ops, text in (([dim, bright], "waits"), ([bright, Op(flags=("bright",))], "raised by"), ([bright, Op(reports="light")], "both report"), ([Op(consumes={"m": "*"}), Op(produces={"m": "*"}, name="late")], "late makes it")):
        with pytest.raises(ChainError, match=text):
            check_chain(ops)
    graph = dict(outputs={"classes": list}, records={"target": "*"})
    for delivered, text in (({}, "nothing is delivered"), ({"classes": "a"}, "is a str"), ({"classes": [], "more": 1}, "no slots"), ({"classes": [], "target": 3}, "is a name")):
        with pytest.raises(ContractError, match=text):
            GraphContract("g", delivered=delivered, **graph).check()
    with pytest.raises(ContractError, match="no entries"):
        GraphContract("g", delivered={"classes": ["a"], "target": "gone"}, **graph).stream(small)
    with pytest.raises(ContractError, match="declared under"):
        GraphContract("g", {"x": list}, {"x": "*"}).check()
    done = GraphContract("g", delivered={"classes": ["a"], "target": "file"}, **graph)
    assert done.class_names == ["a"] and values(done.stream(small), "target") == values(small, "file")
    with pytest.raises(ContractError):
        ClassNames(("a", "a"))


def test_declared_algorithms(small):
    class Gain(Algorithm):
        factor = Param()
        x = Input()
        y = Output("Signal", replaces="x")

        def compute(self, x):
            return {"y": x * self.factor}

    class Twice(Gain):
        factor = Param(2)

    assert [s.name for s in algorithm_spec(Twice)["param"]] == ["factor"] and Twice().produces == {"x": "Signal"}
    out = Twice(keys={"x": "id"})(small)
    assert values(out, "id") == [0, 2, 4, 6, 8] and out.kinds["id"] == "Signal"
    assert values(Twice(keys={"x": "id", "y": "z"})(small), "z") == [0, 2, 4, 6, 8]
    check_chain([Twice(keys={"x": "id"})], ["id"])
    for bad, text in ((lambda: Gain(), "needed"), (lambda: Twice(gain=1), "no slots"), (lambda: Twice(keys={"factor": "f"}), "no slots"), (lambda: type("Lost", (Algorithm,), {"y": Output(replaces="x")}), "no input")):
        with pytest.raises(TypeError, match=text):
            bad()
    with pytest.raises(ValueError, match="the outputs are"):
        type("Wrong", (Twice,), {"compute": lambda self, x: {}})()(small)


def test_batch_readers(spark, small):
    batch = Stream(SelectFields(["id", "x", "a"])(small)).batch(3)
    assert [r["values"] for r in batch_values(batch, "id").orderBy("batch_id").collect()] == [[0, 1, 2], [3, 4]]
    assert batch_metadata(batch, ["id", "x", "a"]) is None
    with pytest.raises(KeyError, match="no collate"):
        Stream(small).batch(3, "no")
    register_collate("pairs", lambda r, size: collate(r, 2))
    assert "pairs" in registered_collates() and Stream(small).batch(9, "pairs").count() == 3
    bad = spark.sql("SELECT 1L AS batch_id, struct(array(1, 2) AS a, array(1) AS b) AS p, 5 AS one, struct(array('u', 'v') AS predictions) AS w")
    with pytest.raises(Exception, match="lengths differ"):
        per_record_predictions(bad, "p").collect()
    assert [r.prediction for r in per_record_predictions(bad, "one").collect()] == [5]
    assert [(r.place, r.prediction) for r in per_record_predictions(bad, "w").collect()] == [(0, "u"), (1, "v")]


def test_metadata_and_printing(spark, sf_dir, small):
    seen = []
    assert PrintRecord("r", 2, out=seen.append)(small) is small and len(seen) == 3 and "file='d/b.txt'" in seen[2]
    stubs = record_metadata(small.put("n", F.array(F.array(F.lit(1), F.lit(2))))).result().first()
    assert list(stubs.a) == [[3], "double"] and list(stubs.n) == [[1, 2], "int"] and stubs.id == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dataset_uri(docs).endswith("documents.parquet") and dataset_uri(spark.range(3)) is None
    assert len(dataset_uris(docs.select("doc_id").union(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")))) == 2
    masked = small.put("image", small["a"], "Image").put("mask", small["a"], "Mask")
    assert masked.targets(None) == ["image"] and masked.targets("mask") == ["mask"]
    with pytest.raises(KeyError):
        masked.targets("no")


def test_models(spark):
    r = records(spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 1.0])], "id bigint, a array<double>"), "id")
    assert values(ModelPredict(lambda: lambda x: x, "a", batch_size=1)(r), "class_idx") == [1, None, 0]
    assert values(ModelSegment(lambda: lambda x: x, "a")(r), "prediction_mask") == [[1, 2], None, [3, 1]]
    found = values(ModelDetect(lambda: lambda x: [{"boxes": [list(v) * 2], "scores": [1], "labels": [7]} for v in x], "a", (10, 20))(r), "prediction")
    assert found[1] is None and found[2].labels == [7] and found[2].boxes[0].y1 == 1.0 and found[2].canvas.width == 20.0
    with pytest.raises(Exception, match="answers for"):
        ModelPredict(lambda: lambda x: x[:0], "a")(r).result().collect()
    ragged = records(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id bigint, a array<double>").coalesce(1), "id")
    with pytest.raises(Exception, match="differ in length"):
        ModelSegment(lambda: lambda x: x, "a")(ragged).result().collect()
