"""CSV folders and files with decimal commas, and pairs of original and synthetic files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.operators.clean import select_rename

CANDIDATES = (";", ",", "\t", "|")
_WHOLE, _REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def dataset_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ``*.csv`` entries of a folder, single files or folders of part files: ``dataset, path``."""
    root = folder.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    # file paths are absolute URIs: what follows the listed folder is the entry
    rooted = F.regexp_extract("path", "^(.*?" + re.escape("/" + root.split(":", 1)[-1].strip("/") + "/") + ")", 1)
    inside = F.expr("substring(path, length(rooted) + 1)")
    files = files.withColumn("rooted", rooted)
    entry = F.element_at(F.split(inside, "/"), 1)
    found = files.select(entry.alias("dataset")).filter(F.col("dataset").endswith(".csv")).distinct()
    return found.select(
        F.regexp_replace("dataset", r"\.csv$", "").alias("dataset"),
        F.concat(F.lit(root + "/"), F.col("dataset")).alias("path"),
    )


def sniff(spark: SparkSession, paths: dict[str, str]) -> dict[str, dict]:
    """Per name: ``sep`` (None if it cannot be told), ``encoding`` and ``multiline``; two aggregates over all lines of all files.

    The separator is the candidate whose count outside quotes agrees on most lines. The encoding is UTF-8 when every
    line is valid, else ISO-8859-1. A line with an odd number of quotes means that fields run over several lines.
    """
    lines = reduce(
        DataFrame.unionByName,
        [spark.read.text(path).select(F.lit(name).alias("name"), "value") for name, path in paths.items()],
    )
    bare = F.regexp_replace(F.regexp_replace("value", '"[^"]*"', ""), '".*$', "")
    counts = F.array(
        *[F.struct(F.lit(c).alias("sep"), (F.length("bare") - F.length(F.replace("bare", F.lit(c)))).alias("k")) for c in CANDIDATES]
    )
    seen = lines.select("name", bare.alias("bare")).select("name", F.inline(counts)).where("k > 0")
    votes = seen.groupBy("name", "sep", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("name", "sep").agg(F.max("n").alias("n"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    facts = lines.groupBy("name").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(quotes % 2 == 1).alias("open")
    )
    out = {name: {"sep": None, "encoding": "UTF-8", "multiline": False} for name in paths}
    for r in facts.collect():  # one row per file
        out[r["name"]] |= {"encoding": "UTF-8" if r["valid"] else "ISO-8859-1", "multiline": r["open"]}
    best: dict[str, list] = {}
    for r in votes.collect():  # one row per file and candidate
        best.setdefault(r["name"], []).append((r["n"], r["sep"]))
    for name, found in best.items():
        most = max(n for n, _ in found)
        winners = [c for n, c in found if n == most]
        out[name]["sep"] = winners[0] if len(winners) == 1 else None
    return out


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate whose count agrees on most lines of the file."""
    found = sniff(spark, {"": path})[""]["sep"]
    if found is None:
        raise ValueError(f"cannot tell the delimiter of {path}; pass sep")
    return found


def _number(c, decimal: str):
    return F.regexp_replace(c, ",", ".") if decimal == "," else c


def infer_types(df: DataFrame, decimal: str = ",") -> T.StructType:
    """Long, double, boolean or string per text column, from one aggregate pass."""
    tests = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        filled = c.isNotNull()
        tests += [
            # patterns, since a cast also takes suffixes: 1d is a code, not a number
            F.bool_and(F.when(filled, c.rlike(_WHOLE) & c.try_cast("bigint").isNotNull())).alias(f"l{i}"),
            F.bool_and(F.when(filled, _number(c, decimal).rlike(_REAL))).alias(f"d{i}"),
            F.bool_and(F.when(filled, c.isin("True", "False", "true", "false"))).alias(f"b{i}"),
        ]
    row = df.agg(*tests).first()
    fields = []
    for i, name in enumerate(df.columns):
        kind: T.DataType = T.StringType()
        if row[f"l{i}"]:
            kind = T.LongType()
        elif row[f"d{i}"]:
            kind = T.DoubleType()
        elif row[f"b{i}"]:
            kind = T.BooleanType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def typed(df: DataFrame, schema: T.StructType, decimal: str = ",", formats: dict[str, str] | None = None) -> DataFrame:
    """Cast text columns to the schema; numbers may use a decimal comma, dates their format."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = _number(c, decimal).cast(f.dataType)
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)) and (formats or {}).get(f.name):
            c = F.try_to_timestamp(c, F.lit(formats[f.name])).cast(f.dataType)
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    decimal: str = ",",
    encoding: str | None = None,
    schema: T.StructType | None = None,
    columns: list | None = None,
    names: list[str] | None = None,
    formats: dict[str, str] | None = None,
    known: dict | None = None,
) -> DataFrame:
    """A CSV file with a header. What is not given (separator, encoding, types) is found out first.

    Quoted fields may hold line breaks; a file that has some is read whole by one task per part file. ``known`` is
    what ``sniff`` said of the file.
    """
    known = known or sniff(spark, {"": path})[""]
    sep = sep or known["sep"]
    if sep is None:
        raise ValueError(f"cannot tell the delimiter of {path}; pass sep")
    how = {"sep": sep, "encoding": encoding or known["encoding"], "multiLine": known["multiline"]}
    text = spark.read.options(header=True, quote='"', escape='"', **how).csv(path)
    if columns is not None:
        picked = [text.columns[c] if isinstance(c, int) else c for c in columns]
        text = select_rename(text, picked, names or picked)
    return typed(text, schema or infer_types(text, decimal), decimal, formats)


def read_folder(spark: SparkSession, folder: str, **options) -> dict[str, DataFrame]:
    """Every dataset of a folder by name; an empty folder is an error."""
    found = dataset_files(spark, folder).orderBy("dataset").collect()  # one row per dataset
    if not found:
        raise FileNotFoundError(f"no csv files in {folder}")
    paths = {r["dataset"]: r["path"] for r in found}
    known = sniff(spark, paths)
    return {name: read_csv(spark, path, known=known[name], **options) for name, path in paths.items()}


def write_csv(df: DataFrame, path: str, decimal: str = ",", sep: str = ";", bom: bool = True, mode: str = "errorifexists") -> None:
    """CSV with decimal comma; the byte order mark goes in front of the header."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) and decimal != ".":
            c = F.regexp_replace(c.cast("string"), r"\.", decimal)
        out.append(c.alias(("\ufeff" if bom and i == 0 else "") + f.name))
    df.select(*out).write.mode(mode).options(
        sep=sep, header=True, encoding="UTF-8", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def pair_datasets(spark: SparkSession, originals: str, synthetics: str) -> DataFrame:
    """Originals with their synthetic files named ``<method>_<dataset>``: ``dataset, method, original, synthetic``.

    An original without any synthetic file is an error.
    """
    orig = dataset_files(spark, originals).withColumnRenamed("path", "original")
    parts = F.split("dataset", "_", 2)
    syn = dataset_files(spark, synthetics).select(
        parts[0].alias("method"), F.element_at(parts, -1).alias("dataset"), F.col("path").alias("synthetic")
    )
    pairs = orig.join(syn, "dataset", "left")
    missing = [r[0] for r in pairs.filter("synthetic IS NULL").select("dataset").head(10)]
    if missing:
        raise FileNotFoundError(f"no synthetic files for {missing}")
    return pairs.select("dataset", "method", "original", "synthetic")
