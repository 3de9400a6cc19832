"""Box matching over whole batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.operators import regions
from recordloom.plans.record import records

SIDES = ("x0", "y0", "x1", "y1")
BOXES = pa.list_(pa.struct([(k, pa.float64()) for k in SIDES]))


def one_by_one(truth, predicted, labels, threshold):
    """The matches of one record, with Python's own lists."""
    t, p = (np.array([[b[k] for k in SIDES] for b in x or []], float).reshape(-1, 4) for x in (truth, predicted))
    iou = regions.overlaps(t, p)
    one, other = ((list(x or []) + [None] * len(boxes))[: len(boxes)] for x, boxes in zip(labels, (t, p)))
    for a in range(len(t)):
        for b in range(len(p)):
            if one[a] != other[b]:
                iou[a, b] = 0.0
    pairs = regions.greedy_matches(iou, threshold)
    left = [[k for k in range(len(boxes)) if k not in {x[side] for x in pairs}] for side, boxes in enumerate((t, p))]
    return {"matched": [{"truth": a, "predicted": b, "iou": float(iou[a, b])} for a, b in pairs], "fn": left[0], "fp": left[1]}


@pytest.mark.parametrize("held", [1 << 18, 10])
def test_batch_matches(monkeypatch, held):
    """Nulls, no boxes, boxes without extent, labels that are missing or too many, ties, records of many shapes."""
    monkeypatch.setattr(regions, "OVERLAPS", held)
    draw = np.random.default_rng(5)

    def boxes(most):
        corners = draw.integers(0, 5, (int(draw.integers(0, most + 1)), 4)).astype(float)
        return None if draw.random() < 0.1 else [dict(zip(SIDES, (x, y, x + w, y + h if h else None))) for x, y, w, h in corners]

    def labels(most):
        return None if draw.random() < 0.1 else [[None, "a", "b"][k] for k in draw.integers(0, 3, int(draw.integers(0, most + 3)))]

    for most in (2, 9):
        rows = [(boxes(most), boxes(most), labels(most), labels(most)) for _ in range(300)]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (BOXES, BOXES, pa.list_(pa.string()), pa.list_(pa.string())))]
        for threshold in (0.0, 0.4):
            got = regions.batch_matches(*(x.slice(3) for x in columns[:2]), [x.slice(3) for x in columns[2:]], threshold).to_pylist()
            assert got == [one_by_one(t, p, (tl, pl), threshold) for t, p, tl, pl in rows[3:]]
    assert len(regions.batch_matches(pa.array([], BOXES), pa.array([], BOXES), None, 0.5)) == 0


def test_records_of_one_shape_together(monkeypatch):
    """Time per record: none of 10,000 records of two boxes is matched on its own."""
    monkeypatch.setattr(regions, "greedy_matches", None)
    some = pa.array([[dict(zip(SIDES, (k, 0.0, k + 2.0, 2.0))) for k in (0.0, 1.0)]] * 10_000, BOXES)
    got = regions.batch_matches(some, some, None, 0.5)
    assert set(map(str, got.to_pylist())) == {str({"matched": [{"truth": k, "predicted": k, "iou": 1.0} for k in (0, 1)], "fn": [], "fp": []})}


def test_match_boxes_labels(spark):
    """Labels of one type and of two, and none."""
    box = "array(named_struct('x0', 0d, 'y0', 0d, 'x1', 2d, 'y1', 2d))"
    r = records(spark.range(3).selectExpr("id", f"{box} AS t", f"{box} AS p", "array(id) AS a", "array(1L) AS b", "array('1') AS c"), "id")
    for labels, want in ((("a", "b"), [0, 1, 0]), (("a", "c"), [0, 1, 0]), ((None, None), [1, 1, 1])):
        out = regions.MatchBoxes("t", "p", *labels)(r)
        got = out.result().select("id", F.size("matches.matched").alias("n"), "matches.fn").orderBy("id").collect()
        assert [x.n for x in got] == want and [x.fn for x in got] == [[] if n else [0] for n in want]
