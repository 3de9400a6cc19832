"""What models deliver, as contracts: fields with types, compared with the analysed plan before any job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import arrays as A
from recordloom.operators.contract import ContractError
from recordloom.plans.record import Record

_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass(frozen=True)
class OutputField:
    """A field of what a model delivers: how deep its arrays are nested, what they hold at last, and the entry it is
    (``{}`` stands for the operator's output name)."""

    depth: int
    holds: str
    entry: str = "{}"
    required: bool = True

    def fits(self, kind: T.DataType) -> bool:
        for _ in range(self.depth):
            if not isinstance(kind, T.ArrayType):
                return False
            kind = kind.elementType
        return kind.simpleString() == self.holds or (isinstance(kind, T.StructType) and self.holds == "struct")

    def __str__(self) -> str:
        return "array<" * self.depth + self.holds + ">" * self.depth


@dataclass(frozen=True)
class OutputContract:
    """``fields`` stand in entries of their own, or, where ``struct``, inside one struct entry named by the output."""

    name: str
    fields: Mapping[str, OutputField]
    struct: bool = False

    def entries(self, output: str) -> dict[str, str]:
        """Field -> entry, for the fields that must be there."""
        return {k: (output if self.struct else f.entry.format(output)) for k, f in self.fields.items() if f.required}

    def check(self, r: Record, output: str, who: str) -> Record:
        """The record, if its entries hold what the contract promises; a missing or other one is refused by name, without a job."""
        if self.struct:
            if output not in r.entries:
                raise ContractError(f"{who}: no entry {output!r} to hold a {self.name} (entries: {list(r.entries)})")
            self.check_struct(r.frame.schema[r.entries[output]].dataType, who, output)
            return r
        for name, f in self.fields.items():
            entry = f.entry.format(output)
            if entry not in r.entries:
                if f.required:
                    raise ContractError(f"{who}: {self.name} lacks {name!r}, no entry {entry!r} (entries: {list(r.entries)})")
                continue
            kind = r.frame.schema[r.entries[entry]].dataType
            if not f.fits(kind):
                raise ContractError(f"{who}: {name!r} of {self.name} (entry {entry!r}) is {kind.simpleString()}, not {f}")
        return r

    def check_struct(self, kind: T.DataType, who: str, entry: str) -> None:
        if not isinstance(kind, T.StructType):
            raise ContractError(f"{who}: entry {entry!r} is {kind.simpleString()}, not a {self.name} with {list(self.fields)}")
        for name, f in self.fields.items():
            if name not in kind.names:
                if f.required:
                    raise ContractError(f"{who}: {self.name} in entry {entry!r} lacks {name!r} (fields: {kind.names})")
            elif not f.fits(kind[name].dataType):
                raise ContractError(f"{who}: {name!r} of {self.name} in entry {entry!r} is {kind[name].dataType.simpleString()}, not {f}")


CLASSIFICATION = OutputContract("classification", {"logits": OutputField(1, "double", "{}_scores"), "probs": OutputField(1, "double", "probs"), "class_idx": OutputField(0, "bigint", "class_idx")})
SEGMENTATION = OutputContract("segmentation", {"logits": OutputField(2, "double", "{}_logits", False), "probs": OutputField(2, "double", "{}_probs", False), "mask": OutputField(1, "bigint", "{}_mask")})
RESTORATION = OutputContract("restoration", {"image": OutputField(1, "double", "{}")})
DETECTION = OutputContract("detection", {"boxes": OutputField(1, "struct"), "labels": OutputField(1, "bigint"), "scores": OutputField(1, "double"), "canvas": OutputField(0, "struct", required=False)}, struct=True)


def check_input(r: Record, build, field: str, who: str) -> None:
    """Refuses, by name and without a job, a model that cannot be built and an entry that is no array of numbers."""
    if not callable(build):
        raise ContractError(f"{who}: build is a {type(build).__name__}, not a function that makes the model")
    if field not in r.entries:
        raise ContractError(f"{who}: no entry {field!r} for the model (entries: {list(r.entries)})")
    kind = r.frame.schema[r.entries[field]].dataType
    if not isinstance(kind, T.ArrayType) or kind.elementType.simpleString() not in _NUMBERS:
        raise ContractError(f"{who}: entry {field!r} is {kind.simpleString()}, a model takes an array of numbers")


def classification_output(logits: Column) -> Column:
    """Scores as a classification: logits as they are, their softmax, and the class of the highest (the first at a tie)."""
    logits = logits.cast("array<double>")
    probs = A.softmax(logits)
    return F.when(logits.isNotNull(), F.struct(logits.alias("logits"), probs.alias("probs"), A.argmax(logits).cast("bigint").alias("class_idx")))


def segmentation_output(logits: Column) -> Column:
    """Scores by class and pixel as a segmentation: logits, their softmax over the classes of a pixel, and the highest class of each."""
    logits = logits.cast("array<array<double>>")
    pixels = F.sequence(F.lit(0), F.greatest(F.size(F.get(logits, F.lit(0))), F.lit(1)) - 1)
    columns = F.when(F.size(F.get(logits, F.lit(0))) > 0, F.transform(pixels, lambda p: F.transform(logits, lambda c: F.get(c, p)))).otherwise(F.array().cast("array<array<double>>"))
    soft = F.transform(columns, lambda x: A.softmax(x))
    probs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(logits), F.lit(1)) - 1), lambda c: F.transform(soft, lambda x: F.get(x, c)))
    mask = F.transform(columns, lambda x: A.argmax(x).cast("bigint"))
    return F.when(logits.isNotNull(), F.struct(logits.alias("logits"), probs.alias("probs"), mask.alias("mask")))


def restoration_output(image: Column) -> Column:
    """A restored image as it is: in the units of the input, not clamped."""
    image = image.cast("array<double>")
    return F.when(image.isNotNull(), F.struct(image.alias("image")))
