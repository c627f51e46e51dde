"""Reuse of the original's personal data and quasi-identifier tuples in a synthetic table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.values import texts_of
from twinlake.operators.joins import heavy_tuples, mark_exists


def _check_name(cols: list[str]) -> str:
    return "+".join(cols)


def pii_leak(o: DataFrame, s: DataFrame, cols, heavy: dict | None = None) -> DataFrame:
    """``s`` with a flag ``<cols>_in_original``: the value or tuple occurs in the original."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    name = f"{_check_name(cols)}_in_original"
    if all(o.schema[c].dataType == s.schema[c].dataType for c in cols):
        return mark_exists(s, o, cols, name, (heavy or {}).get(tuple(cols)))
    # the two files were read with different types: compare the values as text
    keys = [f"__key_{i}" for i in range(len(cols))]
    named = lambda df, other: dict(zip(keys, texts_of(df, other, cols).values()))
    return mark_exists(s.withColumns(named(s, o)), o.withColumns(named(o, s)), keys, name).drop(*keys)


def _keys(df: DataFrame, other: DataFrame, checks: list[list[str]], side: str) -> DataFrame:
    """One row per row and check; the key is the tuple as text, keeping NULLs and borders."""
    pairs = [
        F.struct(
            F.lit(_check_name(cols)).alias("check"),
            F.array(*texts_of(df, other, cols).values()).alias("key"),
        )
        for cols in checks
    ]
    return df.select(F.inline(F.array(*pairs))).select(
        "check", "key", *[F.lit(int(side == x)).alias(x) for x in ("o", "s")]
    )


def leak_report(o: DataFrame, s: DataFrame, checks: list[list[str]]) -> DataFrame:
    """Per check: synthetic rows, rows whose tuple occurs in the original, and their share.

    One aggregate over both sides answers every check; there is no join, and a
    tuple shared by many rows shrinks before the shuffle.
    """
    both = _keys(o, s, checks, "o").unionByName(_keys(s, o, checks, "s"))
    per_key = both.groupBy("check", "key").agg(F.max("o").alias("o"), F.sum("s").alias("s"))
    return per_key.groupBy("check").agg(
        F.sum("s").alias("total"),
        F.sum(F.when(F.col("o") == 1, F.col("s")).otherwise(0)).alias("matched"),
    ).withColumn("share", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))


def quasi_leak(o: DataFrame, s: DataFrame, combos: list[list[str]]) -> DataFrame:
    """``s`` with one flag per quasi-identifier combination; the heavy tuples of all of them are counted in one pass."""
    combos = [list(c) for c in combos]
    heavy = heavy_tuples(s, combos)
    for cols in combos:
        s = pii_leak(o, s, cols, heavy)
    return s
