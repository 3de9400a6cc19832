"""Detection targets: boxes of any layout to the one form of the record model, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import boxes as B
from recordloom.plans.record import Record

_BOXES, _LABELS, _SCORES = ("bbox", "boxes"), ("category", "categories", "label", "labels"), ("score", "scores")


def _parts(r: Record, key: str) -> tuple[dict[str, str], str]:
    """Names of the parts of a box entry (fields of its struct), and its type."""
    kind = r.frame.schema[r.entries[key]].dataType
    names = kind.fieldNames() if hasattr(kind, "fieldNames") else []
    found = {part: next((n for n in names_ if n in names), None) for part, names_ in (("boxes", _BOXES), ("labels", _LABELS), ("scores", _SCORES))}
    return {k: v for k, v in found.items() if v}, kind.simpleString()


def _boxish(r: Record, key: str) -> bool:
    parts, kind = _parts(r, key)
    return "boxes" in parts or kind.startswith(("array<array<", "array<struct<x0:"))


@dataclass(frozen=True)
class ConvertToBoxes:
    """A struct of boxes with labels and scores, a plain array of rows of four numbers, or boxes already converted, as a target.

    The target is a struct of boxes (half-open corners), labels, scores (null where there are none) and canvas (height,
    width; null where ``size`` is not given). ``field`` left out means the first entry with boxes. ``size`` names the
    entries that hold height and width, by which ``normalized`` rows are scaled before they are converted.
    """

    field: str = ""
    output: str = "target"
    format: str = "xyxy"
    normalized: bool = False
    classes: tuple[str, ...] | None = None
    size: tuple[str, str] | None = None

    def __post_init__(self):
        if self.format not in B.FORMATS:
            raise ValueError(f"format is one of {B.FORMATS}")
        if self.normalized and not self.size:
            raise ValueError("normalized boxes need the size of the image")

    def __call__(self, r: Record) -> Record:
        key = self.field or next((k for k in r.entries if _boxish(r, k)), "")
        if not key or key not in r.entries or not _boxish(r, key):
            raise ValueError(f"entry {self.field!r} holds no boxes (entries: {list(r.entries)})")
        parts, _ = _parts(r, key)
        value = r[key]
        rows = value[parts["boxes"]] if parts else value
        height, width = (r[k].cast("double") for k in self.size) if self.size else (None, None)
        made = dict(parts)
        element = r.frame.select(rows.alias("x")).schema["x"].dataType.elementType
        corners = (lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])) if hasattr(element, "fieldNames") else (lambda b: b)
        scale = (width, height) if self.normalized else (None, None)
        boxes = F.transform(F.coalesce(rows, F.array().cast(f"array<{element.simpleString()}>")), lambda b: B.from_numbers(corners(b), self.format, *scale))
        labels = value[made["labels"]] if "labels" in made else F.lit(None).cast("array<bigint>")
        scores = value[made["scores"]].cast("array<double>") if "scores" in made else F.lit(None).cast("array<double>")
        canvas = F.struct(height.alias("height"), width.alias("width")) if self.size else F.lit(None).cast("struct<height: double, width: double>")
        out = r.put(self.output, F.struct(boxes.alias("boxes"), labels.alias("labels"), scores.alias("scores"), canvas.alias("canvas")), "Boxes")
        return Record(out.frame, out.entries, out.order, out.kinds, self.classes or out.class_names)


@dataclass(frozen=True)
class ConvertFromBoxes:
    """The inverse: rows of four numbers in a layout, in a struct (bbox, category, score) or as a plain array.

    ``normalized`` rows are shares of the target's canvas.
    """

    field: str = "target"
    output: str = "class"
    format: str = "xyxy"
    normalized: bool = False
    container: str = "objects"

    def __post_init__(self):
        if self.format not in B.FORMATS or self.container not in ("objects", "array"):
            raise ValueError(f"format is one of {B.FORMATS}, container is objects or array")

    def __call__(self, r: Record) -> Record:
        if self.field not in r.entries or r.kinds.get(self.field) != "Boxes":
            raise ValueError(f"entry {self.field!r} holds no boxes (entries: {list(r.entries)})")
        value, scale = r[self.field], (None, None)
        if self.normalized:
            bad = F.raise_error(F.lit("a target without a canvas cannot be normalized")).cast("double")
            scale = tuple(F.coalesce(value["canvas"][k], bad) for k in ("width", "height"))
        rows = F.transform(value["boxes"], lambda b: B.to_numbers(b, self.format, *scale))
        if self.container == "array":
            return r.put(self.output, rows)
        names = r.frame.schema[r.entries[self.field]].dataType.fieldNames()
        parts: list[Column] = [rows.alias("bbox"), *(value[a].alias(b) for a, b in (("labels", "category"), ("scores", "score")) if a in names)]
        return r.put(self.output, F.struct(*parts))
