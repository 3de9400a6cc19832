"""Images in rows: struct<height, width, channels, data>, data the bytes of height x width x channels, and kernels over them.

Kernels are numpy over all images of one shape in an Arrow batch at once: arrays of images x height x width x channels. The
functions that they use take any number of axes in front.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<height: int, width: int, channels: int, data: binary>"
_FIELDS = [pa.field("height", pa.int32()), pa.field("width", pa.int32()), pa.field("channels", pa.int32()), pa.field("data", pa.binary())]


#: Bytes of the images of one shape that a kernel gets at once, unless one image alone has more.
BLOCK_BYTES = 1 << 18


def pixels(x) -> np.ndarray:
    return np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["channels"])


def image(a: np.ndarray) -> dict:
    a = a[:, :, None] if a.ndim == 2 else a
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def _block(data: pa.Array, shape) -> np.ndarray:
    """Binary values of one length as an array of images."""
    _, offsets, raw = data.buffers()
    at = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return raw.reshape(len(data), *shape)


def _binaries(block: np.ndarray) -> pa.Array:
    """Images of one shape as binary values."""
    n, size = len(block), block[0].size if len(block) else 0
    at = (np.arange(n + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(block, np.uint8).tobytes())])


def over_shapes(function: Callable[..., np.ndarray], structs: list[pa.Array]) -> pa.Array:
    """A function of arrays of images, called for each combination of shapes, and for so many images that its arrays stay small; null where an input is."""
    there = np.ones(len(structs[0]), bool)
    shapes, datas = [], []
    for x in structs:
        height, width, channels, data = (x.field(k) for k in range(4))
        there &= x.is_valid().to_numpy(zero_copy_only=False) & data.is_valid().to_numpy(zero_copy_only=False)
        shapes += [c.fill_null(0).to_numpy(zero_copy_only=False) for c in (height, width, channels)]
        datas.append(data)
    rows = np.flatnonzero(there)
    forms, of = np.unique(np.stack(shapes, axis=1)[rows], axis=0, return_inverse=True)
    sizes, parts, order = np.zeros((len(there), 3), np.int32), [], []
    for k, form in enumerate(forms):
        same, step = rows[of.ravel() == k], max(1, BLOCK_BYTES // max(1, *form.reshape(-1, 3).prod(axis=1).tolist()))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            made = function(*[_block(d.take(pa.array(some)), form[3 * n : 3 * n + 3]) for n, d in enumerate(datas)])
            made = made[..., None] if made.ndim == 3 else made
            sizes[some] = made.shape[1:]
            parts.append(_binaries(made))
            order.append(some)
    place = np.full(len(there), -1)
    place[np.concatenate([np.zeros(0, np.int64), *order])] = np.arange(len(rows))
    none = ~there
    data = pa.concat_arrays([pa.array([], pa.binary()), *parts]).take(pa.array(place, mask=none))
    columns = [pa.array(sizes[:, n], mask=none) for n in range(3)]
    return pa.StructArray.from_arrays([*columns, data], fields=_FIELDS, mask=pa.array(none))


def kernel(function: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A function of arrays of images as a function of image columns; null where an input is null."""

    def over(*columns: Column) -> Column:
        @F.arrow_udf(IMAGE)
        def run(*structs: pa.Array) -> pa.Array:
            return over_shapes(function, list(structs))

        return run(*columns)

    return over


def luma(a: np.ndarray) -> np.ndarray:
    """Grey by ITU-R 601, in whole numbers."""
    w = a[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471])
    return (w + 0x8000 >> 16).astype(np.uint8)


def converted(a: np.ndarray, mode: str) -> np.ndarray:
    channels = a.shape[-1]
    if mode == "L":
        return luma(a) if channels >= 3 else a[..., 0]
    rgb = a[..., :3] if channels >= 3 else np.repeat(a[..., :1], 3, axis=-1)
    if mode == "RGB":
        return rgb
    if mode == "RGBA":
        alpha = a[..., 3:4] if channels == 4 else np.full((*a.shape[:-1], 1), 255, np.uint8)
        return np.concatenate([rgb, alpha], axis=-1)
    raise ValueError("mode is L, RGB or RGBA")


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def axis(n: int, to: int):
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(a.shape[-3], height)
    x0, x1, fx = axis(a.shape[-2], width)
    f = a.astype(float)
    rows = f[..., y0, :, :] * (1 - fy)[:, None, None] + f[..., y1, :, :] * fy[:, None, None]
    out = rows[..., x0, :] * (1 - fx)[:, None] + rows[..., x1, :] * fx[:, None]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def channel(a: np.ndarray, number: int) -> np.ndarray:
    """One channel, the nearest there is; -1 is their mean."""
    if number == -1:
        return np.rint(a.mean(axis=-1)).astype(np.uint8)
    return a[..., min(max(number, 0), a.shape[-1] - 1)]


def tensor(x: Column) -> Column:
    """struct<shape, data> in channel, row, column order, of an image column, in JVM expressions."""
    h, w, c = x["height"], x["width"], x["channels"]
    code = F.hex(x["data"])

    def one(k: Column) -> Column:
        place = (k % (h * w)) * c + F.floor(k / (h * w)).cast("int")
        return F.conv(F.substring(code, 2 * place + 1, F.lit(2)), 16, 10).cast("int")

    return F.when(x.isNotNull(), F.struct(F.array(c, h, w).alias("shape"), F.transform(F.sequence(F.lit(0), h * w * c - 1), one).alias("data")))


def frame(x: Column) -> Column:
    """struct<height, width> of the raster that boxes on an image are stated in; null where there is no image."""
    return F.when(x["data"].isNotNull(), F.struct(x["height"].alias("height"), x["width"].alias("width")))


def fitted_size(height: int, width: int, to_width: int | None, to_height: int | None, longest: int = 512) -> tuple[int, int]:
    """(height, width) by the size rules: both given, exact; one given and the other 0, its aspect; one given and
    the other None, kept; both 0, the longest side bounded; both None, as it is."""
    if to_width is None and to_height is None:
        return height, width
    if (to_width or 0) > 0 and (to_height or 0) > 0:
        return to_height, to_width
    if (to_width or 0) > 0:
        return (height if to_height is None else max(1, round(height * to_width / width))), to_width
    if (to_height or 0) > 0:
        return to_height, (width if to_width is None else max(1, round(width * to_height / height)))
    if to_width is None or to_height is None:
        raise ValueError("a side of 0 needs the other one")
    ratio = min(1.0, longest / max(height, width))
    return max(1, round(height * ratio)), max(1, round(width * ratio))


def padded(a: np.ndarray, height: int, width: int, value: int = 0) -> np.ndarray:
    if a.shape[-3] > height or a.shape[-2] > width:
        raise ValueError("the image is larger than asked for")
    sides = [(0, 0)] * (a.ndim - 3) + [(0, height - a.shape[-3]), (0, width - a.shape[-2]), (0, 0)]
    return np.pad(a, sides, constant_values=value)


def stitched(images: list[np.ndarray], layout: str = "row", gap: int = 4, background: int | tuple[int, int, int] = 0) -> np.ndarray:
    """Images side by side, one under another, or in a grid of ceil(sqrt(n)) columns.

    A row is as tall as its tallest image, a column as wide as its widest; a smaller one stands in its cell's upper left corner.
    """
    images = [converted(a, "RGB") for a in images]
    columns = {"row": len(images), "column": 1, "grid": int(np.ceil(np.sqrt(len(images))))}[layout]
    cells = [images[k : k + columns] for k in range(0, len(images), columns)]
    heights = [max(a.shape[-3] for a in row) for row in cells]
    widths = [max(row[k].shape[-2] for row in cells if k < len(row)) for k in range(columns)]
    tops, lefts = (np.cumsum([0, *[n + gap for n in side]])[:-1] for side in (heights, widths))
    lead = images[0].shape[:-3]
    out = np.full((*lead, sum(heights) + gap * (len(heights) - 1), sum(widths) + gap * (columns - 1), 3), np.array(background, np.uint8), np.uint8)
    for y, row in zip(tops, cells):
        for x, a in zip(lefts, row):
            out[..., y : y + a.shape[-3], x : x + a.shape[-2], :] = a
    return out


def decoded(content: bytes) -> np.ndarray | None:
    """Pixels of a binary PPM or PGM file or a NumPy file of bytes; None for anything else."""
    try:
        if content[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while content[at : at + 1].isspace():
                    at += 1
                if content[at : at + 1] == b"#":
                    at = content.index(b"\n", at)
                    continue
                end = at
                while not content[end : end + 1].isspace():
                    end += 1
                head.append(int(content[at:end]))
                at = end
            width, height, _ = head
            channels = 3 if content[:2] == b"P6" else 1
            return np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
        if content[:6] == b"\x93NUMPY":
            a = np.load(io.BytesIO(content), allow_pickle=False)
            return a if a.dtype == np.uint8 and a.ndim in (2, 3) else None
    except (ValueError, IndexError):
        return None
    return None


def decode(content: Column) -> Column:
    """The image of a file's bytes; all fields null where it cannot be read."""

    @F.pandas_udf(IMAGE)
    def run(contents: pd.Series) -> pd.DataFrame:
        none = {"height": None, "width": None, "channels": None, "data": None}
        made = [decoded(bytes(c)) if c is not None else None for c in contents]
        return pd.DataFrame([none if a is None else image(a) for a in made], columns=list(none)).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return run(content)


def from_array(values: Column, width: int, channels: int = 1) -> Column:
    """An image of a flat array of whole numbers from 0 to 255, in JVM expressions."""
    data = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))
    height = F.floor(F.size(values) / (width * channels)).cast("int")
    return F.struct(height.alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), data.alias("data"))
