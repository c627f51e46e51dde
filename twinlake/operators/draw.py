"""Draw values in proportion to counts, by equality joins only.

A draw is an integer position below the total count of its group; the value
whose run of positions covers it is the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.rand import below, step_lookup
from twinlake.operators.joins import attach, null_safe
from twinlake.operators.rank import global_cumulative
from twinlake.sources.scratch import materialize

# Groups with up to this many values carry them as one array per group.
ARRAY_LEVELS = 256
# Beyond that the positions are cut into blocks of at least this many.
BLOCK = 64


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))


def _pick(runs: Column, pos: Column) -> Column:
    """The value of the first run that ends after the position.

    The position is bound once a row: Spark would put its digest into the inner lambda and compute it for every run.
    """
    return F.transform(F.array(pos), lambda p: F.filter(runs, lambda r: r["hi"] > p)[0]["v"])[0]


def draw_weighted(df: DataFrame, cells: DataFrame, by: list[str], value: str, u: Column, out: str) -> DataFrame:
    """Add ``out``: a value of ``cells`` (columns ``by``, ``value``, ``__n``) drawn with ``u``.

    ``by`` names columns of both tables; rows of a group without cells get NULL.
    ``cells`` should be a written table, as it is read more than once.
    """
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("__levels"), F.sum("__n").alias("__total"))
    top = sizes.agg(F.max("__levels"), F.sum("__levels"), F.sum("__total")).first()
    if top[0] is None:
        return df.withColumn(out, F.lit(None).cast(cells.schema[value].dataType))
    if top[0] <= ARRAY_LEVELS:
        return _draw_array(df, cells, by, value, u, out)
    return _draw_block(df, cells, by, value, u, out, top[1], top[2])


def _draw_array(df, cells, by, value, u, out):
    if not by:
        known = cells.select(value, "__n").orderBy(F.col(value).asc_nulls_first()).collect()  # ARRAY_LEVELS rows at most
        kind, cuts, run = cells.schema[value].dataType, [], 0
        for r in known:
            run += r["__n"]
            cuts.append(run)
        values = [F.lit(r[value]).cast(kind) for r in known]
        return df.withColumn("__pos", below(u, run)).withColumn(out, step_lookup(F.col("__pos"), cuts, values)).drop("__pos")
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first())
    runs = cells.withColumn("__hi", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    table = materialize(
        runs.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(
            F.array_sort(F.collect_list(F.struct(F.col("__hi").alias("hi"), F.col(value).alias("v")))).alias("__runs"),
            F.max("__hi").alias("__total"),
        )
    )
    joined = df.join(table, null_safe(df, table, [(c, f"__{c}") for c in by]), "left")
    joined = joined.withColumn("__pos", below(u, F.col("__total")))
    joined = joined.withColumn(out, _pick(F.col("__runs"), F.col("__pos")))
    return joined.select(*df.columns, out)


def _draw_block(df, cells, by, value, u, out, levels, total):
    # a block holds no more values than positions; common values span many blocks
    width = BLOCK * (1 + total // (levels * 1024))
    ranked, _, _ = global_cumulative(
        cells.select(*by, F.col(value).alias("__v"), "__n"),
        [*by, F.col("__v").asc_nulls_first()],
        "__n",
    )
    ranked = ranked.select(*[F.col(c).alias(f"__{c}") for c in by], "__v", "__n", "cum")
    keys = [f"__{c}" for c in by]
    spans = materialize(
        ranked.groupBy(*keys).agg(F.min(F.col("cum") - F.col("__n")).alias("__start"), F.sum("__n").alias("__total"))
    )
    if by:
        placed = attach(ranked, spans, keys)
        drawn = df.join(spans, null_safe(df, spans, list(zip(by, keys))), "left")
    else:
        placed = ranked.select("*", F.lit(0).alias("__start"))
        drawn = df.withColumn("__total", F.lit(total))
    hi = F.col("cum") - F.col("__start")
    first, last = F.floor((hi - F.col("__n")) / width), F.floor((hi - 1) / width)
    blocks = placed.select(*keys, "__v", hi.alias("__hi"), F.explode(F.sequence(first, last)).alias("__block"))
    table = blocks.groupBy(*keys, "__block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__hi").alias("hi"), F.col("__v").alias("v")))).alias("__runs")
    )
    drawn = drawn.withColumn("__pos", below(u, F.col("__total")))
    drawn = drawn.withColumn("__at", F.floor(F.col("__pos") / width))
    drawn = drawn.select(*df.columns, "__pos", "__at")
    on = drawn["__at"] == table["__block"]
    if by:
        on = on & null_safe(drawn, table, list(zip(by, keys)))
    joined = drawn.join(table, on, "left").withColumn(out, _pick(F.col("__runs"), F.col("__pos")))
    return joined.select(*df.columns, out)
