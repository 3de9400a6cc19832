"""Masks and boxes where the work is inherently one record at a time: small numpy kernels behind Arrow UDFs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import boxes as B
from recordloom.plans.record import Record

BOXES = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def _lists(values: pa.Array, counts: np.ndarray, none: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=none)


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def components(mask: np.ndarray, connectivity: int = 4, min_area: int = 1) -> list[tuple[float, float, float, float]]:
    """Half-open boxes of connected true cells, in the order of their first cell by rows."""
    return stack_components(mask[None], connectivity, min_area)[0]


def stack_components(masks: np.ndarray, connectivity: int = 4, min_area: int = 1) -> list[list[tuple[float, float, float, float]]]:
    """components() of many masks of one shape (masks x height x width) at once."""
    out: list[list[tuple[float, float, float, float]]] = [[] for _ in masks]
    for k, corners in zip(*(x.tolist() for x in component_corners(masks, connectivity, min_area))):
        out[k].append(tuple(corners))
    return out


def component_corners(masks: np.ndarray, connectivity: int = 4, min_area: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The mask that each box is of, in order, and the boxes (x0, y0, x1, y1) of many masks of one shape.

    Neighbouring cells are edges; the least place spreads along them, with pointers shortened between turns, so the
    turns are few however long a part winds.
    """
    masks = np.asarray(masks, bool)
    n, height, width = masks.shape
    place = np.arange(masks.size).reshape(masks.shape)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    ends = []
    for dy, dx in steps:
        here = (slice(None), slice(0, height - dy), slice(max(0, -dx), width - max(0, dx)))
        there = (slice(None), slice(dy, height), slice(max(0, dx), width + min(0, dx)))
        both = masks[here] & masks[there]
        ends.append((place[here][both], place[there][both]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    label = np.arange(masks.size)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    cells = np.flatnonzero(masks.ravel())
    roots, which, area = np.unique(label[cells], return_inverse=True, return_counts=True)
    y, x = cells // width % height, cells % width
    box = np.empty((4, len(roots)))
    box[:2], box[2:] = np.inf, -np.inf
    for k, (fold, value) in enumerate(((np.minimum, x), (np.minimum, y), (np.maximum, x + 1), (np.maximum, y + 1))):
        fold.at(box[k], which, value)
    large = area >= min_area
    return roots[large] // max(1, height * width), box.T[large]


#: Cells of masks that are searched at once, unless one mask alone has more.
CELLS = 1 << 17


@dataclass(frozen=True)
class ConnectedComponents:
    """Boxes of the connected parts of a flat boolean mask of ``width`` columns."""

    field: str
    width: int
    min_area: int = 1
    connectivity: int = 4
    output: str = "boxes"

    def __call__(self, r: Record) -> Record:
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity is 4 or 8")
        width, area, connectivity = self.width, self.min_area, self.connectivity

        @F.arrow_udf(BOXES)
        def found(masks: pa.Array) -> pa.Array:
            sizes = _counts(masks)
            values, starts = masks.flatten(), _starts(sizes)
            values = values.fill_null(False if pa.types.is_boolean(values.type) else 0).to_numpy(zero_copy_only=False).astype(bool)
            whose, corners = [np.zeros(0, int)], [np.zeros((0, 4))]
            for size in np.unique(sizes[sizes > 0]).tolist():
                same, step = np.flatnonzero(sizes == size), max(1, CELLS // size)
                for k in range(0, len(same), step):
                    some = same[k : k + step]
                    of, boxes = component_corners(values[starts[some][:, None] + np.arange(size)].reshape(len(some), -1, width), connectivity, area)
                    whose.append(some[of])
                    corners.append(boxes)
            whose, corners = np.concatenate(whose), np.concatenate(corners)
            corners = corners[np.argsort(whose, kind="stable")]
            boxes = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in corners.T], ["x0", "y0", "x1", "y1"])
            return _lists(boxes, np.bincount(whose, minlength=len(masks)), masks.is_null())

        return r.put(self.output, found(r[self.field]), "Boxes")


def instance_boxes(mask: Column, width: int) -> Column:
    """One half-open box for each value other than 0 of a flat mask, in ascending order, as column expressions."""
    values = F.array_sort(F.array_distinct(F.filter(mask, lambda v: v != 0)))
    cells = F.transform(mask, lambda v, i: F.struct(v.alias("v"), (i % width).alias("x"), F.floor(i / width).alias("y")))

    def one(value: Column) -> Column:
        mine = F.filter(cells, lambda c: c["v"] == value)
        xs, ys = F.transform(mine, lambda c: c["x"]), F.transform(mine, lambda c: c["y"])
        box = B.box(F.array_min(xs), F.array_min(ys), F.array_max(xs) + 1, F.array_max(ys) + 1)
        return F.struct(value.alias("value"), box.alias("box"))

    return F.transform(values, one)


@dataclass(frozen=True)
class MasksToDetectionBoxes:
    """A detection target (boxes, labels) of a mask of ``width`` columns.

    Each value other than 0 is an instance, or, where ``connected``, each connected part of what is not 0. All get ``label``.
    """

    field: str
    width: int
    label: int = 1
    connected: bool = False
    min_area: int = 1
    connectivity: int = 4
    output: str = "target"

    def __call__(self, r: Record) -> Record:
        mask = r[self.field]
        if self.connected:
            flags = r.put("__flags", F.transform(mask, lambda v: v.cast("int") != 0))
            found = ConnectedComponents("__flags", self.width, self.min_area, self.connectivity, "__boxes")(flags)
            boxes = found["__boxes"]
            out = found
        else:
            counted = F.filter(instance_boxes(mask, self.width), lambda x: F.size(F.filter(mask, lambda v: v == x["value"])) >= self.min_area)
            out, boxes = r, F.transform(counted, lambda x: x["box"])
        target = F.struct(boxes.alias("boxes"), F.transform(boxes, lambda b: F.lit(self.label).cast("bigint")).alias("labels"))
        out = out.put(self.output, target, "Boxes")
        return out.with_entries({k: v for k, v in out.entries.items() if k not in ("__flags", "__boxes")})


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all rows (x0, y0, x1, y1) of two arrays, or of each two in two stacks; 0 where the union is empty."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    both = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None) * np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
    size_a, size_b = ((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b))
    union = size_a + size_b - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def greedy_matches(iou: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of at least the threshold by descending overlap, then by place, each side once."""
    pairs: list[tuple[int, int]] = []
    free = [np.ones(n, bool) for n in iou.shape]
    for k in np.argsort(-iou, axis=None, kind="stable").tolist():
        a, b = divmod(k, iou.shape[1])
        if iou[a, b] < threshold:
            break
        if free[0][a] and free[1][b]:
            free[0][a] = free[1][b] = False
            pairs.append((a, b))
    return pairs


def stack_matches(iou: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """greedy_matches() of many tables of one shape at once: table, truth and predicted, each table's pairs in their order."""
    n, _, width = iou.shape
    table, left = np.arange(n), iou.copy()
    found = [np.zeros((3, 0), int)]
    for _ in range(min(iou.shape[1:])):
        best = left.reshape(len(left), -1).argmax(axis=1)
        sure = np.take_along_axis(left.reshape(len(left), -1), best[:, None], axis=1)[:, 0] >= threshold
        table, left, (a, b) = table[sure], left[sure], divmod(best[sure], width)
        if not len(table):
            break
        found.append(np.stack([table, a, b]))
        at = np.arange(len(table))
        left[at, a], left[at, :, b] = -np.inf, -np.inf
    table, a, b = np.concatenate(found, axis=1)
    return table, a, b


#: Overlaps that are held at once, unless one record alone has more.
OVERLAPS = 1 << 18

MATCHES = "struct<matched: array<struct<truth: int, predicted: int, iou: double>>, fn: array<int>, fp: array<int>>"


def _corners(boxes: pa.Array) -> np.ndarray:
    """All boxes of a batch, one under another; what is null is no number and overlaps nothing."""
    flat = boxes.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten()))
    return np.stack([fields[k].cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("x0", "y0", "x1", "y1")], axis=1)


def _label_codes(labels: list[pa.Array], sizes: list[np.ndarray]) -> list[np.ndarray]:
    """A number for the label of each box, -1 where it has none; two lists for each record may be shorter or longer than its boxes."""
    values = [x.flatten() for x in labels]
    codes = pa.concat_arrays(values).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = []
    for lists, size, own in zip(labels, sizes, np.split(codes, [len(values[0])])):
        there, record = _counts(lists), np.repeat(np.arange(len(size)), size)
        place = np.arange(len(record)) - _starts(size)[record]
        known = place < there[record]
        code = np.full(len(record), -1)
        code[known] = own[(_starts(there)[record] + place)[known]]
        out.append(code)
    return out


def batch_matches(truth: pa.Array, predicted: pa.Array, labels: list[pa.Array] | None, threshold: float) -> pa.Array:
    """MATCHES of the records of an Arrow batch, those with equal numbers of boxes together."""
    n, boxes = len(truth), [_corners(truth), _corners(predicted)]
    sizes = [_counts(truth), _counts(predicted)]
    starts, codes = [_starts(x) for x in sizes], _label_codes(labels, sizes) if labels else None
    forms, of = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
    order, cuts = np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel(), minlength=len(forms)))
    found, values = [np.zeros((3, 0), int)], [np.zeros(0)]
    for (high, wide), same in zip(forms.tolist(), np.split(order, cuts[:-1])):
        step = max(1, OVERLAPS // max(1, high * wide))
        for k in range(0, len(same) if high and wide else 0, step):
            some = same[k : k + step]
            a, b = (start[some][:, None] + np.arange(size) for start, size in zip(starts, (high, wide)))
            iou = overlaps(boxes[0][a], boxes[1][b])
            if codes:
                iou[codes[0][a][:, :, None] != codes[1][b][:, None, :]] = 0.0
            if len(some) >= min(high, wide):
                at, x, y = stack_matches(iou, threshold)
            else:
                at, x, y = np.array([(m, *pair) for m, one in enumerate(iou) for pair in greedy_matches(one, threshold)], int).reshape(-1, 3).T
            found.append(np.stack([some[at], x, y]))
            values.append(iou[at, x, y])
    record, *ends = np.concatenate(found, axis=1)
    turn = np.argsort(record, kind="stable")
    pair = [pa.array(ends[0][turn], pa.int32()), pa.array(ends[1][turn], pa.int32()), pa.array(np.concatenate(values)[turn])]
    out = [_lists(pa.StructArray.from_arrays(pair, ["truth", "predicted", "iou"]), np.bincount(record, minlength=n))]
    for end, size, start in zip(ends, sizes, starts):
        free = np.ones(size.sum(), bool)
        free[start[record] + end] = False
        whose = np.repeat(np.arange(n), size)
        out.append(_lists(pa.array((np.arange(len(whose)) - start[whose])[free], pa.int32()), np.bincount(whose[free], minlength=n)))
    return pa.StructArray.from_arrays(out, ["matched", "fn", "fp"])


@dataclass(frozen=True)
class MatchBoxes:
    """Greedy matches of true and predicted boxes: pairs with their overlap, and the places that are left on each side.

    With labels, only boxes of one label match; a box without a label has none. Null boxes count as no boxes.
    """

    truth: str
    predicted: str
    truth_labels: str | None = None
    predicted_labels: str | None = None
    iou_threshold: float = 0.5
    output: str = "matches"

    def __call__(self, r: Record) -> Record:
        threshold, aware = self.iou_threshold, bool(self.truth_labels and self.predicted_labels)
        if not aware:

            @F.arrow_udf(MATCHES)
            def alone(truth: pa.Array, predicted: pa.Array) -> pa.Array:
                return batch_matches(truth, predicted, None, threshold)

            return r.put(self.output, alone(r[self.truth], r[self.predicted]))
        kinds = [r.frame.schema[r.entries[k]].dataType for k in (self.truth_labels, self.predicted_labels)]
        plain = isinstance(kinds[0].elementType, T.BooleanType | T.IntegralType | T.StringType) and kinds[0].elementType == kinds[1].elementType
        labels = [r[k] if plain else r[k].cast("array<string>") for k in (self.truth_labels, self.predicted_labels)]

        @F.arrow_udf(MATCHES)
        def matched(truth: pa.Array, predicted: pa.Array, truth_labels: pa.Array, predicted_labels: pa.Array) -> pa.Array:
            return batch_matches(truth, predicted, [truth_labels, predicted_labels], threshold)

        return r.put(self.output, matched(r[self.truth], r[self.predicted], *labels))
