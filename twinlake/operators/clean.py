"""Row-wise cleaning: everything here is one projection or filter, so it fuses into the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.rand import as_column
from twinlake.operators.rank import exact_quantiles

# Mappings up to this length become a CASE expression, longer ones a lookup join.
CASE_LIMIT = 200


def drop_identifiers(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*cols)


def move_column(df: DataFrame, col: str, pos: int) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.select(*rest[:pos], col, *rest[pos:])


def select_rename(df: DataFrame, columns, names) -> DataFrame:
    """Column subset by name or position, renamed."""
    if len(columns) != len(names):
        raise ValueError("need one name per column")
    picked = [df.columns[c] if isinstance(c, int) else c for c in columns]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(picked, names)])


def recode_column(col, mapping: dict, default: str = "null") -> Column:
    """Replace values by the mapping; others become NULL or, with 'keep', stay."""
    c = as_column(col)
    out = None
    for old, new in mapping.items():
        hit = c.isNull() if old is None else c == F.lit(old)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return out if default == "null" else out.otherwise(c)


def recode(df: DataFrame, col: str, mapping: dict, default: str = "null") -> DataFrame:
    if default not in ("null", "keep"):
        raise ValueError("default is 'null' or 'keep'")
    kinds = {type(v) for v in mapping.values() if v is not None}
    if len(kinds) > 1 and not kinds <= {int, float}:  # values of several kinds become text, however many there are
        mapping = {k: v if v is None else str(v) for k, v in mapping.items()}
    if len(mapping) <= CASE_LIMIT:
        return df.withColumn(col, recode_column(col, mapping, default))
    table = df.sparkSession.createDataFrame(list(mapping.items()), ["__old", "__new"])
    joined = df.join(table, F.col(col).eqNullSafe(F.col("__old")), "left")
    new = F.col("__new")
    if default == "keep":
        new = F.when(F.col("__old").isNull() & F.col("__new").isNull(), F.col(col)).otherwise(new)
    return joined.withColumn(col, new).drop("__old", "__new")


def null_if(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    return df.withColumns(
        {c: F.when(~F.col(c).isin(*vals), F.col(c)) for c, vals in sentinels.items()}
    )


def fill_sentinel(df: DataFrame, cols, value) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in cols}
    )


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def coalesce_by(selector, choices: dict) -> Column:
    """The column chosen by the value of ``selector``; NULL when no choice matches."""
    s = as_column(selector)
    out = None
    for value, col in choices.items():
        out = (
            F.when(s == F.lit(value), as_column(col))
            if out is None
            else out.when(s == F.lit(value), as_column(col))
        )
    return out


def has_prefix(col, prefix: str) -> Column:
    """Prefix flag; NULL counts as no."""
    return F.coalesce(F.startswith(as_column(col), F.lit(prefix)), F.lit(False))


def suppress_patterns(df: DataFrame, patterns: list[dict]) -> DataFrame:
    """Drop rows that match all columns of any pattern; a NULL value matches nothing."""
    if not patterns:
        return df
    tests = [reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in p.items()]) for p in patterns]
    return df.filter(~F.coalesce(reduce(Column.__or__, tests), F.lit(False)))


def positive_only(df: DataFrame, qty: str) -> DataFrame:
    """Drop non-positive quantities; an unknown quantity stays."""
    return df.filter((F.col(qty) > 0) | F.col(qty).isNull())


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key by an explicit order; a NULL key is one key.

    Spark keeps one row per key and map task before the shuffle (window group
    limit), so a hot key does not gather its rows in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def impute(df: DataFrame, categorical=(), numeric=()) -> DataFrame:
    """Fill NULLs by the most frequent category (ties: smallest) and by the exact median."""
    categorical, numeric = list(categorical), list(numeric)
    fills = {}
    if categorical:
        fills.update(_modes(df, categorical))
    if numeric:
        melted = df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric])
            ).alias("x")
        ).select("x.*")
        for row in exact_quantiles(melted, ["c"], "v", [0.5]).collect():  # one row per column
            fills[row["c"]] = row["quantile"]
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
            for c, v in fills.items()
        }
    )


def _modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column, from one count of (column, value) pairs; ties go by the column's own order."""
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
        ).alias("x")
    ).select("x.*")
    counts = pairs.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    rank = F.when(F.col("c").isin(*ordered), F.col("v").try_cast("decimal(38,9)")) if ordered else F.lit(None).cast("int")
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), rank.alias("rank"), F.col("v"))).alias("b"))
    return {r["c"]: r["b"]["v"] for r in best.collect()}  # one row per column
