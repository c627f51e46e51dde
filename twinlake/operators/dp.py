"""Differentially private aggregates.

The noise is a function of the seed, so a release needs a fresh secret seed;
the same seed must not be used for two releases. Every aggregate presumes one
row per person: bound the contributions first where that does not hold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.rand import below, digest, gumbel, laplace, uniform
from twinlake.operators.aggregate import summary
from twinlake.operators.budget import Budget
from twinlake.operators.rank import global_cumulative


def dp_count(df: DataFrame, eps: float, seed, by: list[str] | None = None) -> DataFrame:
    """Count plus Laplace(1/eps), rounded; per group the noise is drawn from the group key."""
    counts = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"))
    u = uniform(seed, "dp_count", *(by or [F.lit("all")]))
    return counts.select(*(by or []), F.round(F.col("n") + laplace(u, 1 / eps)).cast("long").alias("dp_count"))


def dp_group_counts(df: DataFrame, by: list[str], eps: float, delta: float, seed) -> DataFrame:
    """Noisy counts of the groups whose noisy count passes a threshold; the others do not show at all.

    A group that only one person is in passes with probability ``delta`` at most, so the presence of a rare group
    stays hidden: the release is (eps, delta)-differentially private in the groups as well as in the counts. A group
    of no rows is never released. NULL is a group like others.
    """
    if not 0 < delta < 0.5:
        raise ValueError("delta is between 0 and 0.5")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    noisy = F.col("n") + laplace(uniform(seed, "dp_group_counts", *by), 1 / eps)
    shown = counts.withColumn("__noisy", noisy).where(F.col("__noisy") >= group_threshold(eps, delta))
    return shown.select(*by, F.round("__noisy").cast("long").alias("dp_count"))


def group_threshold(eps: float, delta: float) -> float:
    """The noisy count a group of one person reaches with probability ``delta``."""
    return 1 + math.log(1 / (2 * delta)) / eps


def dp_mean(df: DataFrame, col: str, lo: float, hi: float, eps: float, seed) -> DataFrame:
    """Mean of the values clamped to [lo, hi], half the budget each for the centred sum and the count."""
    mid = (lo + hi) / 2
    x = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(col).cast("double")))
    x = F.when(F.col(col).isNotNull(), x)
    sums = df.agg(F.coalesce(F.sum(x - mid), F.lit(0.0)).alias("s"), F.count(col).alias("n"))
    s = F.col("s") + laplace(uniform(seed, "dp_mean/sum", F.lit(col)), (hi - lo) / 2 / (eps / 2))
    n = F.col("n") + laplace(uniform(seed, "dp_mean/count", F.lit(col)), 1 / (eps / 2))
    mean = F.lit(mid) + s / F.greatest(F.lit(1.0), n)
    return sums.select(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), mean)).alias("dp_mean"))


def dp_quantile(df: DataFrame, col: str, q: float, lo: int, hi: int, eps: float, seed) -> DataFrame:
    """An integer in [lo, hi] near the q-quantile, by the exponential mechanism.

    A candidate scores minus the number of ranks it is away from the wanted
    rank. The data shrinks to a histogram of clamped integers first.
    """
    x = F.floor(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(col)))).cast("long")
    hist = df.filter(F.col(col).isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "v").join(hist, "v", "left").fillna(0, ["n"])
    ranked, _, total = global_cumulative(grid, "v", "n")
    wanted = q * max(total - 1, 0)
    under = F.col("cum") - F.col("n")
    off = F.greatest(under - wanted, wanted - (F.col("cum") - 1), F.lit(0.0))
    score = -off * (eps / 2) + gumbel(uniform(seed, f"dp_quantile/{col}/{q}", "v"))
    return ranked.agg(F.max_by("v", score).alias("dp_quantile"))


def dp_min(df, col, lo, hi, eps, seed) -> DataFrame:
    return dp_quantile(df, col, 0.0, lo, hi, eps, seed).withColumnRenamed("dp_quantile", "dp_min")


def dp_max(df, col, lo, hi, eps, seed) -> DataFrame:
    return dp_quantile(df, col, 1.0, lo, hi, eps, seed).withColumnRenamed("dp_quantile", "dp_max")


def dp_compare(
    df: DataFrame, col: str, lo: int, hi: int, eps: float, seed, budget: Budget | None = None, release: str = "dp_compare"
) -> DataFrame:
    """Exact and private count, mean, min and max side by side; every private value spends ``eps``.

    With a ``budget`` the four are entered in its ledger under ``release`` before anything is computed, and what
    exceeds it is refused; the columns ``epsilon`` and ``spent`` (after the measure) are then added.
    """
    entries = None if budget is None else budget.spend({f"{release}/{m}": eps for m in ("count", "mean", "min", "max")})
    exact = summary(df, [col]).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("exact"))
                    for m, c in (("count", "n"), ("mean", "mean"), ("min", "min"), ("max", "max"))
                ]
            )
        )
    )
    known = df.filter(F.col(col).isNotNull())
    parts = {
        "count": dp_count(known, eps, seed),
        "mean": dp_mean(df, col, lo, hi, eps, seed),
        "min": dp_min(df, col, lo, hi, eps, seed),
        "max": dp_max(df, col, lo, hi, eps, seed),
    }
    private = None
    for m, one in parts.items():
        row = one.select(F.lit(m).alias("measure"), F.col(one.columns[0]).cast("double").alias("private"))
        private = row if private is None else private.unionByName(row)
    both = exact.join(private, "measure")
    if entries is None:
        return both
    spent = [F.struct(F.lit(name.rsplit("/", 1)[1]).alias("measure"), F.lit(e).alias("epsilon"), F.lit(total).alias("spent")) for name, e, total in entries]
    return both.join(df.sparkSession.range(1).select(F.inline(F.array(*spent))), "measure")


def bound_contributions(df: DataFrame, person: str, max_rows: int, seed, row_key: list[str]) -> DataFrame:
    """Keep at most ``max_rows`` rows per person, chosen by a keyed digest of the row key.

    The rows of a person are first cut down within random sub-groups, so a
    person with very many rows never sits in one task.
    """
    keyed = df.withColumn("__h", digest(seed, "contribution", *row_key))
    keyed = keyed.withColumn("__salt", below(uniform(seed, "contribution/salt", *row_key), 64))
    for keys in ([person, "__salt"], [person]):
        w = Window.partitionBy(*keys).orderBy("__h", *row_key)
        keyed = keyed.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_rows).drop("__rn")
    return keyed.drop("__h", "__salt")
