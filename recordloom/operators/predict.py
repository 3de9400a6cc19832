"""Model inference, and what follows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recordloom.functions import arrays as A
from recordloom.functions import boxes as B
from recordloom.operators.contract import ContractError
from recordloom.operators.outputs import CLASSIFICATION, DETECTION, RESTORATION, SEGMENTATION, OutputContract, check_input
from recordloom.plans.record import Record


def answers(build: Callable, size: int, schema: str, each: Callable[[object], list]) -> Callable:
    """A column function: a model, made once in each task, over batches of at most ``size`` arrays of one length.

    ``each`` turns what the model gave for a batch into a list with a value for each row. Null arrays give null and
    do not reach the model.
    """

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for part in parts:
            there = part.dropna()
            done: list = []
            for k in range(0, len(there), size):
                rows = there.iloc[k : k + size]
                if len({len(x) for x in rows}) > 1:
                    raise ValueError("inputs of one batch differ in length")
                found = each(model(np.stack(rows.to_list())))
                if len(found) != len(rows):
                    raise ValueError(f"the model gave {len(found)} answers for {len(rows)} inputs")
                done += found
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            out.loc[there.index] = pd.Series(done, index=there.index, dtype=object)
            yield out

    return run


class Modelled:
    """What the model operators share: an input that is checked, and results held to a contract."""

    delivers: ClassVar[OutputContract]

    @property
    def consumes(self) -> list[str]:
        return [self.field]

    @property
    def produces(self) -> list[str]:
        return list(dict.fromkeys(self.delivers.entries(self.output).values()))

    def __call__(self, r: Record) -> Record:
        who = type(self).__name__
        check_input(r, self.build, self.field, who)
        return self.delivers.check(self.answer(r), self.output, who)


@dataclass(frozen=True)
class ModelPredict(Modelled):
    """Scores of a model for an array entry. ``build`` makes the model once in each task; it maps a batch
    (rows x length) to scores (rows x classes)."""

    build: Callable[[], Callable[[np.ndarray], np.ndarray]]
    field: str
    output: str = "prediction"
    batch_size: int = 256

    delivers: ClassVar[OutputContract] = CLASSIFICATION

    def answer(self, r: Record) -> Record:
        raw = answers(self.build, self.batch_size, "array<double>", lambda scores: list(np.asarray(scores, float)))(r[self.field])
        # softmax where the scores are no probabilities yet
        out = r.put(f"{self.output}_scores", raw)
        x = out[f"{self.output}_scores"]
        proper = (F.array_min(x) >= 0) & (F.abs(A.total(x) - 1) <= 1e-4)
        out = out.put("probs", F.when(proper, x).otherwise(A.softmax(x)))
        return out.put("class_idx", A.argmax(out["probs"]).cast("bigint"))


@dataclass(frozen=True)
class ModelSegment(Modelled):
    """A class for each pixel as ``<output>_mask``: the model's own whole numbers (rows x pixels), or the class of the
    highest score, the first at a tie (rows x classes x pixels)."""

    build: Callable[[], Callable[[np.ndarray], np.ndarray]]
    field: str
    output: str = "prediction"
    batch_size: int = 256

    delivers: ClassVar[OutputContract] = SEGMENTATION

    def answer(self, r: Record) -> Record:
        def masks(got) -> list:
            got = np.asarray(got)
            return list((got.argmax(axis=1) if got.ndim == 3 else got).astype(np.int64))

        return r.put(f"{self.output}_mask", answers(self.build, self.batch_size, "array<bigint>", masks)(r[self.field]), "Mask")


@dataclass(frozen=True)
class ModelRestore(Modelled):
    """The restored image, flat, in the input's units; planes of channels (rows x channels x pixels) become pixels of channels."""

    build: Callable[[], Callable[[np.ndarray], np.ndarray]]
    field: str
    output: str = "prediction"
    batch_size: int = 256

    delivers: ClassVar[OutputContract] = RESTORATION

    def answer(self, r: Record) -> Record:
        def images(got) -> list:
            got = np.asarray(got, float)
            return list((got.transpose(0, 2, 1) if got.ndim == 3 else got).reshape(len(got), -1))

        return r.put(self.output, answers(self.build, self.batch_size, "array<double>", images)(r[self.field]), "Image")


@dataclass(frozen=True)
class ModelDetect(Modelled):
    """Boxes of a model that gives, for each row, a mapping of boxes (n x 4 corners), scores and labels.

    ``canvas`` is the (height, width) that the model answers in. Where ``frame`` names the entries that hold height and
    width of the original, boxes are scaled to it and it is the target's canvas.
    """

    build: Callable[[], Callable[[np.ndarray], list]]
    field: str
    canvas: tuple[float, float]
    frame: tuple[str, str] | None = None
    output: str = "prediction"
    batch_size: int = 64

    delivers: ClassVar[OutputContract] = DETECTION

    def answer(self, r: Record) -> Record:
        def targets(got) -> list:
            for t in got:
                sizes = {k: len(t[k]) for k in ("boxes", "labels", "scores")}
                if len(set(sizes.values())) > 1:
                    raise ValueError(f"ModelDetect: boxes, labels and scores of one image differ in number: {sizes}")
            return [[{"boxes": np.asarray(t["boxes"], float).tolist(), "labels": np.asarray(t["labels"], int).tolist(), "scores": np.asarray(t["scores"], float).tolist()}] for t in got]

        # a struct as such would be a frame in pandas; an array of one struct is a series like the other answers
        schema = "array<struct<boxes: array<array<double>>, labels: array<bigint>, scores: array<double>>>"
        out = r.put(self.output, answers(self.build, self.batch_size, schema, targets)(r[self.field]))
        found = F.get(out[self.output], F.lit(0))
        height, width = (r[k].cast("double") for k in self.frame) if self.frame else (F.lit(float(self.canvas[0])), F.lit(float(self.canvas[1])))
        x, y = width / float(self.canvas[1]), height / float(self.canvas[0])
        boxes = F.transform(found["boxes"], lambda b: B.scaled(B.from_numbers(b), x, y))
        target = F.struct(boxes.alias("boxes"), found["labels"].alias("labels"), found["scores"].alias("scores"), F.struct(height.alias("height"), width.alias("width")).alias("canvas"))
        return out.put(self.output, F.when(found.isNotNull(), target), "Boxes")


@dataclass(frozen=True)
class ClassificationPredictions:
    """Per record: the top class with its probability, and the k most probable; less sure ones are left out."""

    top_k: int = 3
    confidence_threshold: float = 0.0

    accepts: ClassVar[OutputContract] = CLASSIFICATION
    consumes: ClassVar[tuple[str, ...]] = ("probs", "class_idx")
    produces: ClassVar[tuple[str, ...]] = ("confidence", "top")

    def __call__(self, r: Record) -> Record:
        for name in self.consumes:
            if name not in r.entries:
                raise ContractError(f"ClassificationPredictions: no entry {name!r} of a {self.accepts.name} (entries: {list(r.entries)})")
        sure = r.put_all({"confidence": F.get(r["probs"], r["class_idx"].cast("int")), "top": A.top_k(r["probs"], self.top_k)})
        return sure.filter(sure["confidence"] >= self.confidence_threshold)
