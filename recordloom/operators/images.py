"""Image operators of a pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import arrays as A
from recordloom.functions import boxes as B
from recordloom.functions import drawing as D
from recordloom.functions import images as I
from recordloom.plans.record import Record


@dataclass(frozen=True)
class ReadImage:
    """Decode a content entry (bytes); what cannot be read is null."""

    field: str = "content"
    output: str = "image"

    def __call__(self, r: Record) -> Record:
        image = I.decode(r[self.field])
        return r.put(self.output, F.when(image["data"].isNotNull(), image), "Image")


@dataclass(frozen=True)
class ConvertMode:
    field: str
    mode: str = "RGB"

    def __call__(self, r: Record) -> Record:
        mode = self.mode
        if mode not in ("L", "RGB", "RGBA"):
            raise ValueError("mode is L, RGB or RGBA")
        return r.put(self.field, I.kernel(lambda a: I.converted(a, mode))(r[self.field]), "Image")


@dataclass(frozen=True)
class ConvertToImage:
    """An entry as an RGB image, sized by the rules of fitted_size(), upside down where asked.

    An image of one channel, and a flat map of ``columns`` columns (numbers, or booleans as 0 and 255), are coloured by ``colormap``; a map is
    scaled so that ``vmin`` is black and ``vmax`` white, its own least and greatest finite value where they are not given. Images
    of more channels lose alpha. With the map "gray" an image entry keeps its channels.
    """

    field: str
    width: int | None = 0
    height: int | None = 0
    max_size: int = 512
    flip_vertical: bool = False
    output: str = "image"
    colormap: str = "gray"
    vmin: float | None = None
    vmax: float | None = None
    columns: int | None = None

    def __call__(self, r: Record) -> Record:
        return r.put(self.output, self.drawn(r[self.field], r.frame.schema[r.entries[self.field]].dataType), "Image")

    def drawn(self, source: Column, kind: T.DataType) -> Column:
        width, height, longest, flip, colormap = self.width, self.height, self.max_size, self.flip_vertical, self.colormap
        I.fitted_size(1, 1, width, height, longest)
        D.lookup(colormap)
        if self.vmin is not None and self.vmax is not None and self.vmax <= self.vmin:
            raise ValueError(f"vmax must be above vmin: {self.vmin}, {self.vmax}")
        flat = isinstance(kind, T.ArrayType)
        if flat:
            source = map_image(source, kind, self.columns, self.vmin, self.vmax)

        def draw(a):
            h, w = I.fitted_size(a.shape[1], a.shape[2], width, height, longest)
            if a.shape[3] == 1 and (flat or colormap != "gray"):
                a = D.coloured(a, colormap)
            elif colormap != "gray":
                a = I.converted(a, "RGB")
            return I.resized(a[:, ::-1] if flip else a, w, h)

        return I.kernel(draw)(source)


def map_image(x: Column, kind: T.ArrayType, columns: int | None, vmin: float | None = None, vmax: float | None = None) -> Column:
    """A flat map as a grey image of so many columns (one row where none are given); a map without rows is null."""
    if isinstance(kind.elementType, T.BooleanType):
        levels = F.transform(x, lambda v: F.when(v, 255).otherwise(0))
    else:
        levels = A.to_uint8(x, vmin, vmax)
    width = F.lit(columns) if columns else F.size(x)
    data = F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))
    height = F.floor(F.size(x) / width).cast("int")
    bad = F.raise_error(F.concat(F.lit(f"a map of {columns} columns has "), F.size(x), F.lit(" values"))).cast(I.IMAGE)
    made = F.struct(height.alias("height"), width.cast("int").alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return F.when(F.size(x) % F.greatest(width, F.lit(1)) != 0, bad).when(F.size(x) > 0, made)


def value_image(r: Record, key: str, colormap: str = "viridis", max_size: int = 512, columns: int | None = None, width: int = 512, height: int = 160) -> Column:
    """Any entry as an RGB image to look at: images and maps as ConvertToImage makes them, anything else as its text on a dark canvas."""
    kind = r.frame.schema[r.entries[key]].dataType
    numbers = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType | T.BooleanType)
    if numbers or (isinstance(kind, T.StructType) and kind.names == ["height", "width", "channels", "data"]):
        shown = ConvertToImage(key, 0, 0, max_size, colormap=colormap, columns=columns).drawn(r[key], kind)
        return I.kernel(lambda a: I.converted(a, "RGB"))(shown)
    text = r[key].cast("string") if not isinstance(kind, T.StructType | T.ArrayType | T.MapType) else F.to_json(r[key])

    @F.arrow_udf(I.IMAGE)
    def write(texts: pa.Array) -> pa.Array:
        canvas = np.full((height, width, 3), 30, np.uint8)
        cells = max(1, (width - 12) // D.ADVANCE)
        drawn = []
        for t in texts.fill_null("<empty>").to_pylist():
            lines = [t[k : k + cells] for k in range(0, min(len(t), 8 * cells), cells)]
            drawn.append(D.lettered(canvas, "\n".join(lines) or "<empty>", (220, 220, 220), margin=6, wrap=False))
        return pa.array([I.image(a) for a in drawn], pa.struct(I._FIELDS))

    return write(text)


def record_image(r: Record, colormap: str = "viridis", max_size: int = 512, columns: int | None = None) -> Column:
    """The first entry that is an image or a map of numbers, as an RGB image; an error where there is none."""
    for key, column in r.entries.items():
        kind = r.frame.schema[column].dataType
        if isinstance(kind, T.StructType) and kind.names == ["height", "width", "channels", "data"] or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType | T.BooleanType):
            return value_image(r, key, colormap, max_size, columns)
    raise ValueError(f"no entry holds an array (entries: {list(r.entries)})")


@dataclass(frozen=True)
class DrawText:
    """A text on an image entry, which becomes RGB; ``text`` is a constant, or the name of an entry in braces: {key}."""

    field: str
    text: str
    color: str = "white"
    font_size: int = 14
    position: str = "top-left"
    margin: int = 2
    wrap: bool = True

    def __call__(self, r: Record) -> Record:
        how = {"color": D.colour(self.color), "font_size": self.font_size, "position": self.position, "margin": self.margin, "wrap": self.wrap}
        D.lettering("", 1, 1, self.font_size, self.position, self.margin, self.wrap)
        key = self.text[1:-1] if self.text[:1] == "{" and self.text[-1:] == "}" else None
        if key is None:
            text = self.text
            return r.put(self.field, I.kernel(lambda a: D.lettered(I.converted(a, "RGB"), text, **how))(r[self.field]), "Image")

        @F.arrow_udf(I.IMAGE)
        def write(images: pa.Array, texts: pa.Array) -> pa.Array:
            out, order = [], []
            # images that get the same text are drawn on together
            codes = texts.fill_null("").dictionary_encode()
            number = codes.indices.to_numpy()
            for k, text in enumerate(codes.dictionary.to_pylist()):
                some = np.flatnonzero(number == k)
                out.append(I.over_shapes(lambda a, text=text: D.lettered(I.converted(a, "RGB"), text, **how), [images.take(pa.array(some))]))
                order.append(some)
            return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order)))) if out else images

        return r.put(self.field, write(r[self.field], r[key].cast("string")), "Image")


@dataclass(frozen=True)
class PadImage:
    """Pad to the right and below; boxes keep their places, and a boxes entry that is named has the new size as its canvas."""

    field: str
    height: int
    width: int
    value: int = 0
    boxes: str | None = None

    def __call__(self, r: Record) -> Record:
        height, width, value = self.height, self.width, self.value
        out = r.put(self.field, I.kernel(lambda a: I.padded(a, height, width, value))(r[self.field]), "Image")
        if not self.boxes:
            return out
        target, names = r[self.boxes], r.frame.schema[r.entries[self.boxes]].dataType.names
        canvas = F.struct(F.lit(float(height)).alias("height"), F.lit(float(width)).alias("width")).alias("canvas")
        kept = [target[n].alias(n) for n in names if n != "canvas"]
        return out.put(self.boxes, F.when(target.isNotNull(), F.struct(*kept, canvas)), "Boxes")


@dataclass(frozen=True)
class StitchImages:
    """Images of a record as one: in a row, a column or a grid, each with a title above it where ``titles`` are given.

    Fields that the record lacks are left out with their titles; a record with none of them stays as it is.
    """

    fields: Sequence[str]
    layout: str = "row"
    gap: int = 4
    background: int | str = 0
    output: str = "image"
    titles: Sequence[str] | None = None
    title_color: str = "white"
    font_size: int = 14

    def __call__(self, r: Record) -> Record:
        layout, gap, size = self.layout, self.gap, self.font_size
        if layout not in ("row", "column", "grid"):
            raise ValueError("layout is row, column or grid")
        if not self.fields or gap < 0:
            raise ValueError("fields are needed, and a gap of 0 or more")
        if self.titles is not None and len(self.titles) != len(self.fields):
            raise ValueError(f"{len(self.titles)} titles for {len(self.fields)} fields")
        back = D.colour(self.background) if isinstance(self.background, str) else (self.background,) * 3
        ink = D.colour(self.title_color)
        there = [k for k, f in enumerate(self.fields) if f in r.entries]
        names = [self.titles[k] for k in there] if self.titles is not None else None

        def together(*images):
            if names is not None:
                images = [D.titled(I.converted(a, "RGB"), t, ink, back, size) for a, t in zip(images, names)]
            return I.stitched(list(images), layout, gap, back)

        return r.put(self.output, I.kernel(together)(*[r[self.fields[k]] for k in there]), "Image") if there else r


@dataclass(frozen=True)
class ResizeDetection:
    """Resize an image and scale its boxes with it."""

    width: int
    height: int
    image: str = "image"
    boxes: str = "boxes"

    def __call__(self, r: Record) -> Record:
        width, height, source = self.width, self.height, r[self.image]
        x, y = F.lit(float(width)) / source["width"], F.lit(float(height)) / source["height"]
        values = {self.image: I.kernel(lambda a: I.resized(a, width, height))(source), self.boxes: F.transform(r[self.boxes], lambda b: B.scaled(b, x, y))}
        return r.put_all(values, {self.image: "Image", self.boxes: "Boxes"})


@dataclass(frozen=True)
class SelectChannel:
    """One channel as a grey image; -1 is the mean of all."""

    field: str
    channel: int = 0

    def __call__(self, r: Record) -> Record:
        number = self.channel
        return r.put(self.field, I.kernel(lambda a: I.channel(a, number))(r[self.field]), "Image")


@dataclass(frozen=True)
class ConvertToMask:
    """A grey image as a flat mask of whole numbers; more than one channel is an error."""

    field: str
    output: str = "mask"

    def __call__(self, r: Record) -> Record:
        x = r[self.field]
        bad = F.raise_error(F.lit("a mask has one channel")).cast("array<bigint>")
        return r.put(self.output, F.when(x["channels"] == 1, I.tensor(x)["data"].cast("array<bigint>")).when(x.isNotNull(), bad), "Mask")


@dataclass(frozen=True)
class ToTensor:
    """An image in channel, row, column order."""

    field: str = "image"
    output: str | None = None

    def __call__(self, r: Record) -> Record:
        return r.put(self.output or self.field, I.tensor(r[self.field]))
