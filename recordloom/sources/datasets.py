"""A table as a data set of images or values with classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.labels import LabelMap
from recordloom.plans.record import Record, records


def described_columns(frame: DataFrame) -> list[str]:
    """Columns from the description only; no job runs."""
    return list(frame.columns)


def dataset(frame: DataFrame, position: str, input_feature: str, target_feature: str | None = None, metadata_features: Sequence[str] | str = (), count: int = 0, class_names: Sequence[str] | None = None, origin: str = "") -> Record:
    """Entries image (the input), class (the target), one for each metadata column ("*": all others), and where
    the data came from. ``count`` 0 is all; more than there is is all too. Unknown columns are an error."""
    named = [input_feature, *([target_feature] if target_feature else [])]
    extra = [c for c in frame.columns if c not in (*named, position)] if metadata_features == "*" else list(metadata_features)
    if missing := [c for c in (position, *named, *extra) if c not in frame.columns]:
        raise ValueError(f"no columns {missing} (there are {frame.columns})")
    r = records(frame.select(*dict.fromkeys((position, *named, *extra))), position)
    if count:
        r = r.filter(r.position < count)
    entries = {"image": r[input_feature], **({"class": r[target_feature]} if target_feature else {}), **{c: r[c] for c in extra}, **({"origin": F.lit(origin)} if origin else {})}
    out = r.put_all(entries, {"image": "Image", "class": "Label"})
    out = out.with_entries({k: out.entries[k] for k in entries})
    return Record(out.frame, out.entries, out.order, out.kinds, tuple(class_names) if class_names else None)


def class_names(*sources: Record) -> list[str] | None:
    """The first vocabulary that a source has."""
    return next((list(s.class_names) for s in sources if s.class_names), None)


def fitted(r: Record, key: str = "class") -> tuple[Record, LabelMap]:
    """The source with ids for names in an entry, and the map."""
    mapping = LabelMap.fit(r.frame.select(r[key].alias(key)))
    out = r.put(key, mapping.encode(r[key]), "Label")
    return Record(out.frame, out.entries, out.order, out.kinds, tuple(mapping.class_names)), mapping
