"""Flows as mappings, texts with references, selections of files, label tables, confusion matrices, colours and lettering."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions import drawing, images
from recordloom.operators import images as image_ops
from recordloom.operators import labels
from recordloom.operators.arrays import Threshold, resolved
from recordloom.operators.contract import ContractError, GraphContract, register_item_type
from recordloom.operators.structure import Formula, Where
from recordloom.plans.document import flow_of
from recordloom.plans.record import StepReferenceError, records
from recordloom.sources import files
from recordloom.sources.files import file_selection


def source(spark):
    return records(spark.createDataFrame([(0, 2.0, [1.0, 3.0], "1"), (1, 5.0, None, "x"), (2, None, [], None)], "id int, x double, v array<double>, t string"), "id")


class TestDocuments:
    def test_refusals(self, spark):
        r, op = source(spark), Formula("x + 1", "x")
        wrong = [
            ({}, ValueError, "at least one"), ([op], ValueError, "at least one"), ({"a.b": op}, ValueError, "bad step name"), ({"": op}, ValueError, "bad step name"),
            ({"source": op}, ValueError, "taken"), ({"a": {"op": op, "form": "source"}}, ValueError, "unknown keys"), ({"a": 3}, TypeError, "is no operator"),
            ({"a": {"op": op, "from": "b"}, "b": op}, StepReferenceError, "from names 'b'"), ({"a": {"merge_from": ["source", "z"]}}, StepReferenceError, "merge_from names 'z'"),
            ({"a": {"bind": {"key": "source[x]"}}}, ValueError, "needs an operator"), ({"a": {"op": op, "bind": ["x"]}}, TypeError, "is a mapping"),
            ({"a": {"op": op, "bind": {"key": "source"}}}, ValueError, "step\\[entry\\]"), ({"a": {"op": op, "bind": {"no": "source[x]"}}}, ValueError, "no parameter 'no'"),
            ({"a": {"op": op, "bind": {"key": "b[x]"}}, "b": op}, StepReferenceError, "bind of 'key' names 'b'"),
        ]
        for document, error, text in wrong:
            with pytest.raises(error, match=text):
                flow_of(r, document)
        with pytest.raises(StepReferenceError, match="output"):
            flow_of(r, {"a": op}, "b")

    def test_order_and_output(self, spark):
        flow, output = flow_of(source(spark), {"a": Formula("x * 2", "x"), "skip": None, "b": {"op": Where("x > 5"), "from": "a"}}, "skip")
        assert output == "skip" and [s.name for s in flow.steps] == ["a", "skip", "b"]
        assert [r.x for r in flow.result("b").collect()] == [10.0]


class TestTexts:
    def test_resolved(self, spark, monkeypatch):
        monkeypatch.setenv("LOOM_LEVEL", "2.5")
        r = source(spark)
        assert resolved("$LOOM_LEVEL", r) == "2.5" and resolved("plain", r) == "plain"
        out = Threshold("v", "$LOOM_LEVEL", "")(r)
        assert [x.m for x in out.frame.select(out["mask"].alias("m")).collect()] == [[False, True], None, []]
        out = Threshold("v", "{t}")(r.filter(r["id"] == 0))
        assert [x.m for x in out.frame.select(out["mask"].alias("m")).collect()] == [[False, True]]

    def test_refusals(self, spark):
        r = source(spark)
        for text, error in (("{none}", KeyError), ("$LOOM_NOT_SET", KeyError), ("one", ValueError)):
            with pytest.raises(error):
                Threshold("v", text)(r)
        bad = Threshold("v", "{t}")(r.put("v", F.array(F.lit(1.0))))
        with pytest.raises(PySparkException, match="no number"):
            bad.frame.select(bad["mask"]).collect()


class TestSelection:
    @pytest.fixture()
    def root(self, tmp_path):
        for name in ("A/f1/x.json", "A/f1/y.json", "A/f1/z.json", "A/f2/x.json", "A/f3/deep/x.json", "A/top.json", "A/.hid/x.json", "A/f1/x.dat", "B/g1/x.json", "B/g1/y.tmp"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("{}")
        return str(tmp_path)

    def names(self, spark, root, **how):
        r = file_selection(spark, [f"{root}/A", f"{root}/B"], **{"pattern": "*.json", **how})
        return [x.relative for x in r.result(ordered=True).collect()]

    def test_limits(self, spark, root):
        every = ["A/f1/x", "A/f1/y", "A/f1/z", "A/f2/x", "A/f3/deep/x", "A/top", "B/g1/x"]
        assert self.names(spark, root) == every
        assert self.names(spark, root, max_depth=0) == ["A/top"] and self.names(spark, root, max_depth=1) == [n for n in every if "deep" not in n]
        assert self.names(spark, root, max_subfolders_per_folder=1) == ["A/f1/x", "A/f1/y", "A/f1/z", "A/top", "B/g1/x"]
        assert self.names(spark, root, max_folders_per_set=2) == ["A/f1/x", "A/f1/y", "A/f1/z", "A/top", "B/g1/x"]
        assert self.names(spark, root, max_files_per_folder=1) == ["A/f1/x", "A/f2/x", "A/f3/deep/x", "A/top", "B/g1/x"]
        assert self.names(spark, root, max_files=2) == every[:2]
        assert self.names(spark, root, exclude="f1/*") == every[3:]
        assert self.names(spark, root, pattern=["*.json", "x.*"], companions_of=(".dat",)) == every
        assert self.names(spark, root, relative_to=f"{root}/A")[:1] + self.names(spark, root, relative_to=f"{root}/A")[-1:] == ["f1/x", "B/g1/x"]

    def test_refusals(self, spark, root):
        with pytest.raises(ValueError, match="no files match"):
            self.names(spark, root, pattern="*.none")
        for sets, limit in (([], 0), ([root], -1)):
            with pytest.raises(ValueError, match="sets are needed"):
                file_selection(spark, sets, max_files=limit)


class TestReadFile:
    def test_formats_pairs_and_nulls(self, spark):
        files.register_format("number", ".num", "n: int, origin: string", lambda b: {"n": int(b), "origin": "num"})
        files.register_format("length", ".len", "n: int", lambda b: {"n": len(b)})
        frame = spark.createDataFrame([(0, "a.num", bytearray(b"7")), (1, "b.len", bytearray(b"xyz")), (2, None, None), (3, "a.dat", bytearray(b"?"))], "id int, file string, content binary")
        r = records(frame, "id")
        out = files.ReadFile(formats=("number", "length"), consumed=(".dat",))(r)
        assert [(x.id, x.n, x.origin) for x in out.result(ordered=True).collect()] == [(0, 7, "num"), (1, 3, None), (2, None, None)]
        assert files.ReadFile("none")(r) is r
        with pytest.raises(PySparkException, match="not one of the formats number"):
            files.ReadFile(formats=("number",))(r).result().collect()
        with pytest.raises(ValueError, match="no format 'zip'"):
            files.ReadFile(formats=("zip",))(r)


class TestGraphContracts:
    def test_kinds_and_names(self, spark):
        r = source(spark)
        for outputs, delivered, text in (
            ({"x": "Strem"}, {}, "output 'x' is declared as 'Strem'"), ({"x": "int"}, {"x": "1"}, "slot 'x' is a str, not a int"), ({"x": "float"}, {"x": True}, "not a float"),
            ({"classes": "List[str]"}, {"classes": [1]}, "not a List"), ({"op": "Op"}, {"op": 1}, "not a Op"), ({"source": "Record"}, {"source": "r"}, "not a Record"),
            ({"field": "Op"}, {"field": Threshold("v")}, "name of a parameter of Threshold"),
        ):
            with pytest.raises(ContractError, match=text):
                GraphContract("g", outputs, delivered=delivered).check()
        GraphContract("g", {"op": "Op", "classes": "List[str]", "records": "Record", "n": "int", "one": int}, delivered={"op": Formula("x", "x"), "classes": ["a"], "records": r, "n": 1, "one": 2}).check()
        with pytest.raises(ContractError, match="record entry 'x' is declared as 'Stream'"):
            GraphContract("g", records={"x": "Stream"}).check_declaration()
        with pytest.raises(ContractError, match="'Sound'"):
            GraphContract("g", records={"x": "Sound"}).check_declaration()
        register_item_type("Sound")
        GraphContract("g", records={"x": "Sound"}).check_declaration()


class TestLabels:
    def test_arrays_by_a_join(self, spark, monkeypatch):
        monkeypatch.setattr(labels, "MAP_CLASSES", 1)
        frame = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, None), (3, [None, "c"])], "id int, n array<string>")
        mapping = labels.LabelMap.from_class_names(["a", "b"])
        out = mapping.encoded_all(records(frame, "id"), "n", "k", True, 9).result(ordered=True)
        assert [r.k for r in out.collect()] == [[1, 0, 1], [], None, [None, 9]]
        with pytest.raises(PySparkException, match="unknown class"):
            mapping.encoded_all(records(frame, "id"), "n").result().collect()

    def test_tables(self, spark):
        frame = spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "id int, n string")
        table = labels.LabelTable.fit(frame.select("n"))
        r = labels.EncodeTarget(table, "n", output="k")(records(frame, "id"))
        assert [(x.k, x.n) for x in labels.DecodeTarget(table, "k", output="n")(r).result(ordered=True).collect()] == [(1, "b"), (None, None), (0, "a")]
        assert r.class_names is None

    def test_named_confusion(self, spark):
        rows = spark.createDataFrame([(0, 0), (0, 3), (1, 0), (None, 1)], "t int, p int")
        out = {(r.truth, r.predicted): r for r in labels.named_confusion(rows, "t", "p", ["no", "yes"]).collect()}
        assert len(out) == 16 and out[0, 3]["count"] == 1 and out[0, 3].predicted_name == "3" and out[2, 2].by_row is None and out[0, 0].by_row == 0.5
        assert labels.named_confusion(rows.limit(0), "t", "p", []).collect() == []
        with pytest.raises(ValueError, match="no class"):
            labels.named_confusion(spark.createDataFrame([(-1, 0)], "t int, p int"), "t", "p", [])

    def test_channels(self, spark):
        frame = spark.createDataFrame([([1.0, 5.0, 2.0, 6.0],), (None,), ([7.0],)], "a array<double>")
        assert [r.a for r in labels.channel_values(frame, 2, 1).collect()] == [[5.0, 6.0], None, []]
        assert [r.a for r in labels.channel_values(frame, 2, -1).collect()] == [[3.0, 4.0], None, []]


class TestDrawing:
    def test_colour_maps(self):
        for name in drawing.COLORMAPS:
            table = drawing.lookup(name)
            assert table.shape == (256, 3) and len(np.unique(table, axis=0)) > 150
        assert (drawing.lookup("gray")[:, 0] == np.arange(256)).all()
        for name, low, high in (("viridis", (68, 1, 84), (253, 231, 37)), ("magma", (0, 0, 4), (252, 253, 191)), ("hot", (10, 0, 0), (255, 255, 255)), ("jet", (0, 0, 127), (127, 0, 0))):
            ends = drawing.lookup(name)[[0, 255]].astype(int)
            assert abs(ends - np.array([low, high])).max() <= 12, name
        with pytest.raises(ValueError, match="no colour map"):
            drawing.lookup("none")
        assert drawing.colour("#ff0080") == (255, 0, 128) and drawing.colour("Red") == (255, 0, 0)

    def test_lettering(self):
        points = drawing.lettering("I", 9, 8, margin=1)
        assert ["".join(".#"[int(x)] for x in row) for row in points] == ["........", "..###...", "...#....", "...#....", "...#....", "...#....", "...#....", "..###...", "........"]
        assert drawing.lettering("LONG WORDS", 40, 40).sum() == drawing.lettering("LONG\nWORDS", 40, 40, wrap=False).sum()
        assert drawing.lettering("A", 30, 30, position="bottom-right")[18:, 18:].sum() == drawing.lettering("A", 30, 30)[:12, :12].sum() > 0
        assert drawing.lettering("A" * 99, 5, 5, wrap=False).shape == (5, 5) and drawing.lettering("", 4, 4).sum() == 0
        with pytest.raises(ValueError, match="position"):
            drawing.lettering("A", 9, 9, position="up")

    def frame(self, spark):
        rows = [(0, [0.0, 1.0, 2.0, 4.0], {"height": 1, "width": 2, "channels": 1, "data": bytes([0, 255])}, "HI"), (1, None, None, None), (2, [], {"height": 2, "width": 1, "channels": 3, "data": bytes(range(6))}, "é")]
        return records(spark.createDataFrame(rows, f"id int, v array<double>, i {images.IMAGE}, t string"), "id")

    def test_maps_images_and_texts_as_images(self, spark):
        r = self.frame(spark)
        made = image_ops.ConvertToImage("v", None, None, colormap="gray", columns=2, output="m")(r)
        rows = made.frame.select(made["m"].alias("m")).collect()
        assert list(rows[0].m.data) == [0, 0, 0, 63, 63, 63, 127, 127, 127, 255, 255, 255] and rows[1].m is None and rows[2].m is None
        shown = [x.m for x in r.frame.select(image_ops.value_image(r, "i", "hot").alias("m")).collect()]
        assert (shown[0].channels, shown[1], list(shown[2].data)) == (3, None, list(range(6)))
        texts = [x.m for x in r.frame.select(image_ops.value_image(r, "t", width=60, height=20).alias("m")).collect()]
        assert all((m.height, m.width) == (20, 60) and max(m.data) == 220 for m in texts)
        assert r.frame.select(image_ops.record_image(r).alias("m")).collect()[0].m.height == 1
        with pytest.raises(ValueError, match="no entry holds"):
            image_ops.record_image(r.with_entries({"t": r.entries["t"]}))
        with pytest.raises(PySparkException, match="map of 3 columns"):
            bad = image_ops.ConvertToImage("v", columns=3)(r)
            bad.frame.select(bad["image"]).collect()
        with pytest.raises(ValueError, match="vmax"):
            image_ops.ConvertToImage("v", vmin=1, vmax=1)(r)

    def test_titles_and_texts(self, spark):
        r = self.frame(spark)
        out = image_ops.StitchImages(["i", "none", "i"], "row", 1, "blue", titles=["A", "B", "C"], font_size=9)(r)
        one = out.frame.select(out["image"].alias("m")).first().m
        assert (one.height, one.width, one.channels) == (1 + 15, 2 + 1 + 2, 3)
        drawn = image_ops.DrawText("i", "{t}", "red")(r)
        assert [x.m and x.m.channels for x in drawn.frame.select(drawn["i"].alias("m")).orderBy("m").collect()] == [None, 3, 3]
        for bad in (image_ops.StitchImages([]), image_ops.StitchImages(["i"], titles=["a", "b"]), image_ops.StitchImages(["i"], gap=-1)):
            with pytest.raises(ValueError):
                bad(r)

    def test_padding_moves_the_canvas(self, spark):
        r = self.frame(spark)
        r = r.put("b", F.struct(F.array(F.lit(1)).alias("boxes"), F.struct(F.lit(1.0).alias("height"), F.lit(2.0).alias("width")).alias("canvas")), "Boxes")
        out = image_ops.PadImage("i", 4, 5, 9, "b")(r)
        row = out.frame.select(out["i"].alias("i"), out["b"].alias("b")).first()
        assert (row.i.height, row.i.width, row.b.canvas.height, row.b.canvas.width) == (4, 5, 4.0, 5.0) and list(row.i.data[:5]) == [0, 255, 9, 9, 9]

    def test_kernels_see_one_shape_at_a_time(self):
        import pyarrow as pa

        seen = []

        def function(a):
            seen.append(a.shape)
            return a[..., :1]

        rows = [images.image(np.full((h, w, 3), k, np.uint8)) for k, (h, w) in enumerate([(1, 2), (2, 1), (1, 2), (1, 2)])]
        out = images.over_shapes(function, [pa.array([*rows[:2], None, *rows[2:]], pa.struct(images._FIELDS))])
        assert sorted(seen) == [(1, 2, 1, 3), (3, 1, 2, 3)] and [x and list(x["data"]) for x in out.to_pylist()] == [[0, 0], [1, 1], None, [2, 2], [3, 3]]
