"""What image kernels hold at once, and how many Python workers a task needs for them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recordloom.functions import images as I
from recordloom.operators import regions
from recordloom.plans import queries as plans
from recordloom.plans.record import records


def test_kernels_get_blocks(monkeypatch):
    """A kernel never sees a whole batch of many images, and the rows keep their order."""
    draw = np.random.default_rng(2)
    some = [None if k % 11 == 0 else I.image(draw.integers(0, 256, (4, 5 if k % 3 else 6, 1))) for k in range(500)]
    column, seen = pa.array(some, pa.struct(I._FIELDS)), []

    def doubled(a):
        seen.append(a.nbytes)
        return I.resized(a, 10, 8)

    whole = I.over_shapes(doubled, [column]).to_pylist()
    monkeypatch.setattr(I, "BLOCK_BYTES", 100)
    seen.clear()
    assert I.over_shapes(doubled, [column]).to_pylist() == whole
    assert max(seen) <= 100 and len(seen) > 50
    assert whole == [x and I.image(I.resized(I.pixels(x), 10, 8)) for x in some]
    monkeypatch.setattr(I, "BLOCK_BYTES", 1)
    assert I.over_shapes(doubled, [column]).to_pylist() == whole


def test_components_of_odd_masks(spark, monkeypatch):
    """Null and empty masks, null cells, masks of several heights; a mask's boxes do not depend on the others."""
    rows = [(0, None), (1, []), (2, [True, None, False, True]), (3, [True] * 6), (4, [False] * 4), (5, [True, False, True, True, False, True])]
    r = records(spark.createDataFrame(rows, "id int, mask array<boolean>").coalesce(1), "id")
    got = {x.id: x.boxes and [tuple(b) for b in x.boxes] for x in regions.ConnectedComponents("mask", 2)(r).result().select("id", "boxes").collect()}
    assert got == {0: None, 1: [], 2: [(0, 0, 1, 1), (1, 1, 2, 2)], 3: [(0, 0, 2, 3)], 4: [], 5: [(0, 0, 2, 3)]}


def test_workers_of_a_task(spark):
    """Components, both resizings and the padding run in one worker of a task, the stitching in another."""
    plan = plans.QUERIES["image_resize_stitch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 2
