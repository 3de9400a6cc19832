"""Boxes as structs of corners (x0, y0, x1, y1), half open, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("xyxy", "xywh", "cxcywh")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def from_numbers(values: Column, fmt: str = "xyxy", width: Column | None = None, height: Column | None = None) -> Column:
    """A box from an array of four numbers; shares of ``width`` and ``height`` are scaled before they are converted."""
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    v = [F.get(values, k).cast("double") for k in range(4)]
    if width is not None and height is not None:
        v = [x * (width if k % 2 == 0 else height) for k, x in enumerate(v)]
    a, b, c, d = v
    if fmt == "xyxy":
        return box(a, b, c, d)
    if fmt == "xywh":
        return box(a, b, a + c, b + d)
    return box(a - c / 2, b - d / 2, a + c / 2, b + d / 2)


def to_numbers(b: Column, fmt: str = "xyxy", width: Column | None = None, height: Column | None = None) -> Column:
    """The inverse of from_numbers()."""
    x0, y0, x1, y1 = (b[k] for k in ("x0", "y0", "x1", "y1"))
    v = {"xyxy": (x0, y0, x1, y1), "xywh": (x0, y0, x1 - x0, y1 - y0), "cxcywh": ((x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0)}[fmt]
    if width is not None and height is not None:
        v = tuple(x / (width if k % 2 == 0 else height) for k, x in enumerate(v))
    return F.array(*v)


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    both = w * h
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def pairwise_iou(a: Column, b: Column) -> Column:
    """Matrix of iou() of two arrays of boxes."""
    return F.transform(a, lambda x: F.transform(b, lambda y: iou(x, y)))


def size_bucket(b: Column, bounds: tuple[float, float] = (1024, 9216)) -> Column:
    """small, medium or large, by area."""
    return F.when(area(b) < F.lit(float(bounds[0])), "small").when(area(b) < F.lit(float(bounds[1])), "medium").otherwise("large")


def scaled(b: Column, x: Column, y: Column) -> Column:
    return box(b["x0"] * x, b["y0"] * y, b["x1"] * x, b["y1"] * y)


def coco_to_detection(objects: Column, bbox: str = "bbox", category: str = "category", fmt: str = "xywh", label_offset: int = 0) -> Column:
    """(boxes, labels) from a struct of box arrays and categories; empty arrays, not null, where there are none."""
    boxes = F.transform(F.coalesce(objects[bbox], F.array().cast("array<array<double>>")), lambda v: from_numbers(v, fmt))
    labels = F.transform(F.coalesce(objects[category], F.array().cast("array<int>")), lambda c: (c + F.lit(label_offset)).cast("bigint"))
    return F.struct(boxes.alias("boxes"), labels.alias("labels"))
