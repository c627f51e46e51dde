"""Counts, summaries, distinct values and prevalence; each is one partial-then-final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so results compare across engines."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def melt(df: DataFrame, cols: list[str], kind: str, keep=(), names=("column", "value")) -> DataFrame:
    """One row per kept key and column, the value cast to a common type."""
    pairs = [
        F.struct(F.lit(c).alias(names[0]), F.col(f"`{c}`").cast(kind).alias(names[1])) for c in cols
    ]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__x")).select(*keep, "__x.*")


def group_size(df: DataFrame, by: list[str], name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null count, mean, min and max, one row per column, from a single pass."""
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*structs).alias("__s")).select(F.inline("__s"))


def unique_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per column.

    The exact count de-duplicates (column, value) pairs on the map side before
    the shuffle, so a frequent value costs no more than a rare one.
    """
    if approximate:
        structs = [
            F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("n_distinct")) for c in cols
        ]
        return df.agg(F.array(*structs).alias("__s")).select(F.inline("__s"))
    pairs = melt(df, cols, "string").filter(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def prevalence(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Share of rows with each condition per group; groups without any case of a condition vanish."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, cond in flags.items():
        hit = F.coalesce(cond, F.lit(False)).cast("int")
        aggs.append(F.avg(hit).alias(f"share_{name}"))
    out = df.groupBy(*by).agg(*aggs)
    for name in flags:
        out = out.filter(F.col(f"share_{name}") > 0)
    return out
