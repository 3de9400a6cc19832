"""Listings of files as records, and limits on them."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.plans.record import Record, records
from recordloom.sources.order import with_rank


def _glob(pattern: str, name: Column, relative: Column) -> Column:
    """A pattern without / is held against the name, one with / against the path under the root."""
    return (relative if "/" in pattern else name).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))


def listing(spark: SparkSession, root: str, pattern: str = "*", exclude: list[str] | None = None, contents: bool = False) -> DataFrame:
    """(file, relative, name, length[, content]) of the files under a root; hidden ones are left out.

    Spark lists the files; contents are read only where the column is used.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base.replace("\\", "\\\\") + "/", "")
    table = found.select(F.col("path").alias("file"), relative.alias("relative"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", *(["content"] if contents else []))
    keep = ~F.col("relative").rlike(r"(^|/)\.") & _glob(pattern, F.col("name"), F.col("relative"))
    for x in exclude or []:
        keep &= ~_glob(x, F.col("name"), F.col("relative"))
    return table.filter(keep)


def files(spark: SparkSession, root: str | None = None, paths: list[str] | None = None, pattern: str = "*", exclude: list[str] | None = None) -> Record:
    """Records {file}: a list of paths, or the files under a root in order of path; not both, and not nothing."""
    if (root is None) == (paths is None):
        raise ValueError("a root or a list of paths is needed, not both")
    if paths is not None:
        return records(spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "at bigint, file string"), "at")
    table = listing(spark, root, pattern, exclude)
    if table.isEmpty():
        raise ValueError(f"no files match {pattern!r} under {root}")
    return records(with_rank(table, "at", F.col("relative")), "at")


def select_files(table: DataFrame, max_depth: int = 0, max_subfolders: int = 0, max_folders: int = 0, max_files_per_folder: int = 0, max_files: int = 0) -> DataFrame:
    """Limits on a listing (set, relative), in this order: depth, subfolders of each folder, folders of each
    set, files of each folder, files in all; 0 is no limit. Adds folder."""
    folder = F.regexp_replace("relative", "/?[^/]*$", "")
    table = table.withColumn("folder", folder)
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    if max_depth:
        table = table.filter(depth <= max_depth)
    if max_subfolders:
        deepest = table.agg(F.max(depth)).first()[0] or 0
        for level in range(1, deepest + 1):
            # of each parent at this level, the first folders by name
            parent, own = (F.array_join(F.slice(F.split("folder", "/"), 1, n), "/") for n in (level - 1, level))
            rank = F.dense_rank().over(Window.partitionBy("set", "__parent").orderBy("__own"))
            deep = table.filter(depth >= level).withColumns({"__parent": parent, "__own": own}).withColumn("__rank", rank).filter(F.col("__rank") <= max_subfolders)
            table = table.filter(depth < level).unionByName(deep.drop("__parent", "__own", "__rank"))
    if max_folders:
        rank = F.dense_rank().over(Window.partitionBy("set").orderBy("folder"))
        table = table.withColumn("__rank", rank).filter(F.col("__rank") <= max_folders).drop("__rank")
    if max_files_per_folder:
        rank = F.row_number().over(Window.partitionBy("set", "folder").orderBy("relative"))
        table = table.withColumn("__rank", rank).filter(F.col("__rank") <= max_files_per_folder).drop("__rank")
    if max_files:
        table = table.orderBy("set", "relative").limit(max_files)
    return table


def file_selection(
    spark: SparkSession, sets: list[str], pattern: str | list[str] = "*", exclude: str | None = None, max_depth: int | None = None, max_subfolders_per_folder: int = 0,
    max_folders_per_set: int = 0, max_files_per_folder: int = 0, max_files: int = 0, relative_to: str = "", companions_of: tuple[str, ...] = (),
) -> Record:
    """Records {file, set, relative}: the files of each set (a folder), one set after another, in order of name.

    ``pattern`` is one pattern or several, a file counts once; hidden files and those that match ``exclude`` or end in one of
    ``companions_of`` (halves of pairs that count with the other half) are left out. Then come the limits of select_files(); a
    ``max_depth`` of 0 keeps a set's own files only, None all depths. ``relative`` is the file's place under ``relative_to`` (the set's parent
    folder where that is blank, or the file lies elsewhere) without its last extension. An empty selection is refused, as a limit below 0 is.
    """
    limits = {"max_depth": max_depth or 0, "max_subfolders_per_folder": max_subfolders_per_folder, "max_folders_per_set": max_folders_per_set, "max_files_per_folder": max_files_per_folder, "max_files": max_files}
    if not sets or min(limits.values()) < 0:
        raise ValueError(f"sets are needed, and limits of 0 or more: {limits}")
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    parts = None
    for number, root in enumerate(sets):
        for p in patterns:
            part = listing(spark, root, p, [exclude] if exclude else None).select("file", "relative", F.lit(root.rstrip("/")).alias("set"), F.lit(number).alias("number"))
            parts = part if parts is None else parts.unionByName(part)
    table = parts.distinct()
    for suffix in companions_of:
        table = table.filter(~F.col("file").endswith(suffix))
    if max_depth is not None:
        table = table.filter(F.size(F.split("relative", "/")) - 1 <= max_depth)
    table = table.withColumn("name", F.col("set")).withColumn("set", F.format_string("%08d", "number"))
    table = select_files(table, 0, max_subfolders_per_folder, max_folders_per_set, max_files_per_folder, max_files)
    place = F.concat(F.regexp_extract("name", "([^/]*)$", 1), F.lit("/"), F.col("relative"))
    if relative_to:
        own = F.regexp_replace("file", "^[a-z]+:/*", "/")
        base = relative_to.rstrip("/") + "/"
        place = F.when(own.startswith(base), F.substring(own, len(base) + 1, 1 << 30)).otherwise(place)
    rows = table.select("number", F.col("relative").alias("__order"), "file", F.col("name").alias("set"), F.regexp_replace(place, r"(?<=[^/])\.[^./]*$", "").alias("relative"))
    if rows.isEmpty():
        raise ValueError(f"no files match {patterns} in {sets}")
    # a listing is metadata: a row for each file
    return records(with_rank(rows, "at", F.col("number"), F.col("__order")).drop("number", "__order"), "at").with_entries({k: k for k in ("file", "set", "relative")})


def companions(primary: DataFrame, secondary: DataFrame, suffix: str) -> DataFrame:
    """Pair files rank to rank within a bare name (a leading number and the suffix do not count): (file, companion)."""

    def ranked(t: DataFrame, cut: str, name: str) -> DataFrame:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"^\d+_", ""), cut, "")
        return t.select(F.col("file").alias(name), bare.alias("bare")).withColumn("rank", F.row_number().over(Window.partitionBy("bare").orderBy(name)))

    left = ranked(primary, r"\.[^.]*$", "file")
    return left.join(ranked(secondary, suffix.replace(".", r"\.") + "$", "companion"), ["bare", "rank"], "left").select("file", "companion")


#: Formats by name: the suffix, and the entries (name -> type) that a reader of the bytes gives.
FORMATS: dict[str, tuple[str, str, object]] = {}


def register_format(name: str, suffix: str, schema: str, read) -> None:
    """``read(bytes)`` gives a dict of the schema's entries for files that end in ``suffix``; the first format that matches is used."""
    FORMATS[name] = (suffix, schema, read)


def _reader(read, schema: str):
    names = [part.split(":")[0].strip() for part in schema.split(",")]

    @F.pandas_udf(f"struct<{schema}>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(bytes(c)) if c is not None else dict.fromkeys(names) for c in contents], columns=names)

    return run


def read_files(table: DataFrame, formats: list[str]) -> DataFrame:
    """The listing (file, content) with one struct column for each format, filled where the file is of it.

    A file of no format is an error. A format whose column is not used is not read.
    """
    known = F.lit(False)
    for name in formats:
        suffix, schema, read = FORMATS[name]
        mine = F.col("file").endswith(suffix) & ~known
        known |= F.col("file").endswith(suffix)

        reader = _reader(read, schema)
        table = table.withColumn(name, F.when(mine, reader(F.when(mine, F.col("content")))))
    names = ", ".join(formats)
    return table.filter(known | F.raise_error(F.concat(F.lit(f"not one of the formats {names}: "), "file")).cast("boolean"))


@dataclass(frozen=True)
class ReadFile:
    """Entries of the files that records name, by the first of ``formats`` (all that are registered, where none are named) that matches.

    A record whose ``field`` is null stays as it is. One whose file ends in a suffix of ``consumed`` (the half of a pair whose other
    half has the content) is dropped; a file of no format is an error that names the formats. ``content`` is the entry with the
    bytes; formats whose entries no output reads are not decoded. Formats that give an entry of one name must agree on its type.
    """

    field: str = "file"
    content: str = "content"
    formats: tuple[str, ...] | None = None
    consumed: tuple[str, ...] = ()

    def __call__(self, r: Record) -> Record:
        if self.field not in r.entries:
            return r
        names = list(FORMATS) if self.formats is None else list(self.formats)
        if unknown := [n for n in names if n not in FORMATS]:
            raise ValueError(f"no format {unknown[0]!r} ({list(FORMATS)})")
        file = r[self.field].cast("string")
        for suffix in self.consumed:
            r = r.filter(~F.coalesce(file.endswith(suffix), F.lit(False)))
        known, types, values = F.lit(False), {}, {}
        for name in names:
            suffix, schema, read = FORMATS[name]
            mine = file.endswith(suffix) & ~known
            known |= file.endswith(suffix)
            found = _reader(read, schema)(F.when(mine, r[self.content]))
            for part in schema.split(","):
                key, kind = (x.strip() for x in part.split(":", 1))
                if types.setdefault(key, kind) != kind:
                    raise ValueError(f"entry {key!r} is {types[key]} in one format and {kind} in {name!r}")
                before = values.get(key, F.lit(None).cast(kind))
                values[key] = F.when(mine, found[key]).otherwise(before)
        text = F.concat(F.lit(f"not one of the formats {', '.join(names) or 'none'}: "), file)
        checked = r.filter(file.isNull() | known | F.raise_error(text).cast("boolean"))
        kept = {k: F.when(file.isNull(), r[k]).otherwise(v) if k in r.entries else v for k, v in values.items()}
        return checked.put_all(kept)
