"""What records say about themselves without their payload, and where a table comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.plans.record import Record


def _shape(x, kind: T.DataType) -> list:
    """Lengths of nested arrays, from the first element of each level."""
    sizes = []
    while isinstance(kind, T.ArrayType):
        sizes.append(F.size(x).cast("bigint"))
        x, kind = F.get(x, F.lit(0)), kind.elementType
    return sizes


def record_metadata(r: Record) -> Record:
    """Scalars as they are, structs without their arrays and bytes, arrays as (shape, dtype). Entries keep their names.

    A null array has no stub. Fields that are not read are pruned from the scan.
    """
    kinds = {f.name: f.dataType for f in r.frame.schema.fields}
    out = {}
    for key, column in r.entries.items():
        kind, x = kinds[column], r[key]
        if isinstance(kind, T.ArrayType):
            inner = kind
            while isinstance(inner, T.ArrayType):
                inner = inner.elementType
            stub = F.struct(F.array(*_shape(x, kind)).alias("shape"), F.lit(inner.simpleString()).alias("dtype"))
            out[key] = F.when(x.isNotNull(), stub)
        elif isinstance(kind, T.BinaryType):
            out[key] = F.when(x.isNotNull(), F.struct(F.array(F.octet_length(x).cast("bigint")).alias("shape"), F.lit("binary").alias("dtype")))
        elif isinstance(kind, T.StructType):
            light = [f.name for f in kind.fields if not isinstance(f.dataType, T.ArrayType | T.BinaryType | T.StructType)]
            out[key] = F.when(x.isNotNull(), F.struct(*[x[f"`{n}`"].alias(n) for n in light])) if light else F.lit(None).cast("string")
    return r.put_all(out) if out else r


def dataset_uris(frame: DataFrame) -> list[str]:
    """The folders (or single files) that the rows of a table come from, sorted; nothing is read."""
    files = sorted(frame.inputFiles())
    return sorted({f.rsplit("/", 1)[0] if "/part-" in f else f for f in files})


def dataset_uri(frame: DataFrame) -> str | None:
    """The one place that a table comes from; None if it has none, or several."""
    found = dataset_uris(frame)
    return found[0] if len(found) == 1 else None
