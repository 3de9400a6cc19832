"""Label maps, class statistics, and target operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.plans.record import Record, physical
from recordloom.sources.order import with_rank

#: Classes a map may have as an expression; beyond, encoding is a join.
MAP_CLASSES = 1000
#: Classes a map may have on the driver.
FIT_CLASSES = 1_000_000


def value_of(x: Column, struct: bool) -> Column:
    return x["value"] if struct else x


@dataclass(frozen=True)
class LabelMap:
    """Names and ids of classes."""

    ids: dict[str, int]

    @property
    def num_classes(self) -> int:
        return max(self.ids.values()) + 1 if self.ids else 0

    @property
    def class_names(self) -> list[str]:
        back = {v: k for k, v in self.ids.items()}
        return [back.get(k, str(k)) for k in range(self.num_classes)]

    @classmethod
    def fit(cls, values: DataFrame) -> LabelMap:
        """Distinct values of the only column (an array counts with all its elements), sorted by their bytes, from 0.

        The driver gets one row for each class, FIT_CLASSES at most; for more there is fit_table().
        """
        names = sorted((r.name for r in _names(values).limit(FIT_CLASSES + 1).collect()), key=str.encode)
        if not names:
            raise ValueError("no labels to fit")
        if len(names) > FIT_CLASSES:
            raise ValueError(f"over {FIT_CLASSES} classes: use fit_table()")
        return cls({n: k for k, n in enumerate(names)})

    @classmethod
    def from_class_names(cls, names) -> LabelMap:
        return cls({n: k for k, n in enumerate(names)})

    def encode(self, name: Column, ignore_unknown: bool = False, default: int = 0) -> Column:
        return self._look(name.cast("string"), [(F.lit(k), F.lit(v).cast("bigint")) for k, v in self.ids.items()], ignore_unknown, F.lit(default).cast("bigint"), "bigint")

    def decode(self, number: Column, ignore_unknown: bool = False, default: str | None = None) -> Column:
        return self._look(number.cast("bigint"), [(F.lit(k).cast("bigint"), F.lit(n)) for k, n in enumerate(self.class_names)], ignore_unknown, F.lit(default).cast("string"), "string")

    def encode_all(self, names: Column, ignore_unknown: bool = False, default: int = 0) -> Column:
        """Ids of an array of names, as an expression: for more than MAP_CLASSES classes there is encoded_all(), which joins."""
        return F.transform(names, lambda n: self.encode(n, ignore_unknown, default))

    def _look(self, key: Column, pairs, ignore: bool, default: Column, kind: str) -> Column:
        if len(pairs) > MAP_CLASSES:
            raise ValueError(f"over {MAP_CLASSES} classes: use encoded(), decoded() or encoded_all(), which join")
        found = F.try_element_at(F.create_map(*[x for p in pairs for x in p]), key) if pairs else F.lit(None).cast(kind)
        miss = default if ignore else F.raise_error(F.concat(F.lit("unknown class "), key.cast("string"))).cast(kind)
        return F.when(key.isNull(), F.lit(None).cast(kind)).when(found.isNull(), miss).otherwise(found)

    @property
    def inverse(self) -> dict[int, str]:
        return {v: k for k, v in self.ids.items()}

    def to_ids(self, value: Column, kind: str) -> Column:
        """Ids pass through, also for a map without classes; names are encoded. ``kind`` is the type of the column."""
        return value.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else self.encode(value)

    def encoded(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: int = 0) -> Record:
        """The record with ids for the names of an entry, by a join where there are many classes."""
        if len(self.ids) <= MAP_CLASSES:
            return r.put(output or field, self.encode(r[field], ignore_unknown, default), "Label")
        return self._joined(r, field, output, r[field].cast("string"), [(k, v) for k, v in self.ids.items()], "key string, found bigint", ignore_unknown, default)

    def decoded(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: str | None = None) -> Record:
        """The record with names for the ids of an entry, by a join where there are many classes."""
        if self.num_classes <= MAP_CLASSES:
            return r.put(output or field, self.decode(r[field], ignore_unknown, default), "Label")
        return self._joined(r, field, output, r[field].cast("bigint"), list(enumerate(self.class_names)), "key bigint, found string", ignore_unknown, default)

    def encoded_all(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: int = 0) -> Record:
        """The record with ids for an entry that is an array of names, by a join where there are many classes."""
        if len(self.ids) <= MAP_CLASSES:
            return r.put(output or field, self.encode_all(r[field], ignore_unknown, default), "MultiLabel")
        table = r.frame.sparkSession.createDataFrame(list(self.ids.items()), "name string, id bigint")
        return LabelTable(table).encoded_all(r, field, output, ignore_unknown, default)

    def _joined(self, r: Record, field: str, output: str | None, key: Column, pairs: list, schema: str, ignore: bool, default) -> Record:
        # the driver holds these classes, FIT_CLASSES at most; Spark knows the size of the table and chooses how to join
        return _looked_up(r, field, output, key, r.frame.sparkSession.createDataFrame(pairs, schema), ignore, default)

    def save(self) -> str:
        return json.dumps({"class_names": self.class_names, "num_classes": self.num_classes})

    @classmethod
    def load(cls, text: str) -> LabelMap:
        return cls.from_class_names(json.loads(text)["class_names"])


def _looked_up(r: Record, field: str, output: str | None, key: Column, table: DataFrame, ignore: bool, default) -> Record:
    """The record with what ``table`` (key, found) has for a key; null for null."""
    one, two = physical("key"), physical("found")
    kind = table.schema["found"].dataType.simpleString()
    joined = replace(r, frame=r.frame.join(table.select(F.col("key").alias(one), F.col("found").alias(two)), key == F.col(one), "left"))
    miss = F.lit(default).cast(kind) if ignore else F.raise_error(F.concat(F.lit("unknown class "), key.cast("string"))).cast(kind)
    return joined.put(output or field, F.when(key.isNull(), F.lit(None).cast(kind)).when(F.col(two).isNull(), miss).otherwise(F.col(two)), "Label")


@dataclass(frozen=True)
class LabelTable:
    """Names and ids of classes as a table (name, id), each once: for vocabularies of any size. The driver holds none of it."""

    table: DataFrame

    @classmethod
    def fit(cls, values: DataFrame) -> LabelTable:
        """Distinct values of the only column (an array counts with all its elements), sorted by their bytes, from 0."""
        return cls(fit_table(values))

    class_names = None

    def encoded(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: int = 0) -> Record:
        known = self.table.select(F.col("name").alias("key"), F.col("id").cast("bigint").alias("found"))
        return _looked_up(r, field, output, r[field].cast("string"), known, ignore_unknown, default)

    def decoded(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: str | None = None) -> Record:
        known = self.table.select(F.col("id").cast("bigint").alias("key"), F.col("name").alias("found"))
        return _looked_up(r, field, output, r[field].cast("bigint"), known, ignore_unknown, default)

    def encoded_all(self, r: Record, field: str, output: str | None = None, ignore_unknown: bool = False, default: int = 0) -> Record:
        """Ids for an entry that is an array of names: its elements are joined one by one and gathered by the record's position, in their order."""
        own = [physical("of") for _ in r.order]
        names, place, ids = physical("name"), physical("place"), physical("ids")
        spread = r.frame.select(*[F.col(c).alias(n) for c, n in zip(r.order, own)], F.posexplode(r[field].cast("array<string>")).alias(place, names))
        one = Record(spread, {"name": names}, tuple(own))
        found = self.encoded(one, "name", "id", ignore_unknown, default)
        lists = found.frame.select(*own, F.struct(F.col(place).alias("place"), found["id"].alias("id")).alias(ids)).groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(ids)), lambda x: x["id"]).alias(ids))
        same = F.lit(True)
        for c, n in zip(r.order, own):
            same = same & (F.col(c) == F.col(n))
        joined = replace(r, frame=r.frame.join(lists, same, "left"))
        # an empty array gave no elements
        value = F.when(r[field].isNotNull(), F.coalesce(F.col(ids), F.array().cast("array<bigint>")))
        return joined.put(output or field, value, "MultiLabel")


def _flat(values: DataFrame) -> DataFrame:
    """The only column as ``v``; an array counts with all its elements."""
    (name, kind), *_ = values.dtypes
    return values.select((F.explode(name) if kind.startswith("array") else F.col(name)).alias("v"))


def _names(values: DataFrame) -> DataFrame:
    return _flat(values).select(F.col("v").cast("string").alias("name")).filter("name is not null").distinct()


def fit_table(values: DataFrame) -> DataFrame:
    """(name, id) of the distinct values, sorted; for vocabularies of any size: no task numbers all of them."""
    return with_rank(_names(values), "id", F.col("name")).select("name", "id")


@dataclass(frozen=True)
class EncodeTarget:
    mapping: LabelMap | LabelTable
    field: str
    ignore_unknown: bool = False
    default: int = 0
    output: str | None = None

    def __call__(self, r: Record) -> Record:
        out = self.mapping.encoded(r, self.field, self.output, self.ignore_unknown, self.default)
        names = self.mapping.class_names
        return Record(out.frame, out.entries, out.order, out.kinds, tuple(names) if names else None)


@dataclass(frozen=True)
class DecodeTarget:
    mapping: LabelMap | LabelTable
    field: str
    ignore_unknown: bool = False
    default: str | None = None
    output: str | None = None

    def __call__(self, r: Record) -> Record:
        return self.mapping.decoded(r, self.field, self.output, self.ignore_unknown, self.default)


def class_counts(ids: DataFrame, num_classes: int) -> DataFrame:
    """(class_id, count) for every class; nulls and ids outside the range are not counted."""
    counted = _flat(ids).select(F.col("v").cast("bigint").alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).cast("double").alias("count"))
    every = ids.sparkSession.range(num_classes).withColumnRenamed("id", "class_id")
    return every.join(counted, "class_id", "left").select("class_id", F.coalesce("count", F.lit(0.0)).alias("count"))


def inverse_frequency_weights(counts: DataFrame) -> DataFrame:
    """(class_id, weight): total / (classes * count), 0 where a class was not seen; null weights if nothing was."""
    every = Window.partitionBy(F.lit(0))  # a row for each class
    total, classes = F.sum("count").over(every), F.count(F.lit(1)).over(every)
    weight = F.when(total > 0, F.when(F.col("count") > 0, total / (classes * F.col("count"))).otherwise(F.lit(0.0)))
    return counts.select("class_id", weight.alias("weight"))


def num_classes(ids: DataFrame) -> DataFrame:
    """max + 1 of the only column (an array counts with all elements); null, fractions and no rows are errors."""
    (name, kind), *_ = ids.dtypes
    if "boolean" in kind:
        raise ValueError("booleans are not class ids")
    column = F.array_max(name) if kind.startswith("array") else F.col(name)
    rows = ids.select(column.alias("v"), F.col(name).isNull().alias("none"))
    stats = rows.agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("n"), F.count_if("none").alias("nulls"), F.count_if(F.col("v") != F.floor("v")).alias("odd"))
    bad = F.when(F.col("n") == 0, F.raise_error(F.lit("no classes"))).when(F.col("nulls") > 0, F.raise_error(F.lit("a class is null"))).when(F.col("odd") > 0, F.raise_error(F.lit("a class is not a whole number")))
    return stats.select(F.coalesce(bad.cast("bigint"), F.col("top").cast("bigint") + 1).alias("num_classes"))


def multi_hot(ids: Column, classes: int) -> Column:
    """0/1 for each class; ids outside the range are ignored, no ids give zeros."""
    ids = F.coalesce(ids, F.array().cast("array<bigint>"))
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(ids, i.cast("bigint")).cast("int"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, count, by_row, by_col, by_all), shares to six digits, null where the sum is 0."""
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))

    def share(*by: str) -> Column:
        total = F.sum("count").over(Window.partitionBy(*by))
        return F.round(F.col("count") / F.nullif(total, F.lit(0)), 6)

    return counts.withColumns({"by_row": share("truth"), "by_col": share("predicted"), "by_all": share()})


def named_confusion(rows: DataFrame, truth: str, predicted: str, names: list[str]) -> DataFrame:
    """confusion_matrix() over ids as a full square: (truth, predicted, truth_name, predicted_name, count, by_row, by_col, by_all) for every pair of classes.

    There are as many classes as names, or as the largest id asks for; a class beyond the names is called by its id. A negative id is an error.
    """
    top = rows.agg(F.max(F.greatest(truth, predicted)).alias("top"), F.min(F.least(truth, predicted)).alias("low")).first()
    if top["low"] is not None and top["low"] < 0:
        raise ValueError(f"the id {top['low']} is no class")
    size = max(len(names), 0 if top["top"] is None else int(top["top"]) + 1)
    spark = rows.sparkSession
    # the driver holds the names; Spark makes the square
    called = spark.createDataFrame([(k, names[k] if k < len(names) else str(k)) for k in range(size)], "id bigint, name string")
    axis = lambda c: called.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    counts = rows.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).cast("bigint").alias("truth"), F.col(predicted).cast("bigint").alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    cells = axis("truth").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("predicted")) if size else axis("truth").withColumn("predicted", F.lit(0).cast("bigint"))
    full = cells.join(axis("predicted"), "predicted").join(counts, ["truth", "predicted"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))

    def share(*by: str) -> Column:
        total = F.sum("count").over(Window.partitionBy(*by))
        return F.round(F.col("count") / F.nullif(total, F.lit(0)), 6)

    return full.withColumns({"by_row": share("truth"), "by_col": share("predicted"), "by_all": share()})


def array_stats(values: DataFrame) -> DataFrame:
    """min, max, mean, std (population) and count of the finite elements of the only column, an array."""
    (name, _), *_ = values.dtypes
    flat = values.select(F.explode(F.col(name).cast("array<double>")).alias("x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    return flat.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.mean("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def channel_values(values: DataFrame, channels: int, channel: int = -1) -> DataFrame:
    """The only column, flat images whose pixels have ``channels`` values each, as one value for each pixel: that of a channel, the
    nearest there is, or the mean of all for a negative one."""
    (name, _), *_ = values.dtypes
    a = F.col(name).cast("array<double>")
    pixels = F.when(F.size(a) >= channels, F.sequence(F.lit(0), F.floor(F.size(a) / channels).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    if channel < 0:
        one = lambda k: F.aggregate(F.slice(a, k * channels + 1, F.lit(channels)), F.lit(0.0), lambda x, y: x + y) / channels
    else:
        one = lambda k: F.get(a, k * channels + min(channel, channels - 1))
    return values.select(F.when(a.isNotNull(), F.transform(pixels, one)).alias(name))


def histogram(values: DataFrame, bins: int, low: float | None = None, high: float | None = None, channels: int = 1, channel: int | None = None) -> DataFrame:
    """(bin, count) of the finite elements of the only column, an array; even bins, the last closed.

    The range is the elements' own where it is not given, one wide if they are all equal. Of images with several ``channels``, one
    may be counted alone: channel_values().
    """
    if channel is not None:
        values = channel_values(values, channels, channel)
    (name, _), *_ = values.dtypes
    flat = values.select(F.explode(F.col(name).cast("array<double>")).alias("x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    if low is None or high is None:
        least, most = flat.agg(F.min("x"), F.max("x")).first()
        low, high = (least if low is None else low), (most if high is None else high)
    if low is None:
        return values.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("count"))
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    place = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("bigint")
    counts = flat.filter(F.col("x").between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
