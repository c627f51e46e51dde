"""Per-column agreement of a synthetic or anonymised table with its original.

All columns of a side share one aggregate pass; only the value profile and the
exact medians shuffle, and both shrink to distinct values on the map side first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.values import texts_of
from twinlake.operators.aggregate import melt
from twinlake.operators.rank import exact_quantiles
from twinlake.operators.utility import STEP_ROWS
from twinlake.sources.scratch import materialize


def as_number(df: DataFrame, col: str) -> Column:
    """A column as double; timestamps and dates count microseconds."""
    kind = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000_000
    return c.cast("double")


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[as_number(df, c).alias(c) for c in cols])


#: Ranks between which a median is looked for, and the accuracy of the sketch that finds them.
NEAR, ACCURACY = (0.495, 0.505), 1_000


def _near(c) -> Column:
    """Two values with the median between them: the sketch errs by less than half the distance of their ranks."""
    return F.percentile_approx(c, list(NEAR), ACCURACY)


def column_stats(df: DataFrame, cols: list[str], near: bool = False) -> DataFrame:
    """count, mean, std, min and max per column from one pass; one row per column. ``near`` adds a median bracket."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("lo"),
            F.max(c).alias("hi"),
            *([_near(c).alias("near")] if near else []),
        )
        for c in cols
    ]
    return numbers(df, cols).agg(F.array(*parts).alias("__s")).select(F.inline("__s"))


def _selected(long: DataFrame, brackets: dict[tuple[str, str], list | None]) -> DataFrame:
    """Exact medians of ``long`` (side, column, value, n) by selection: ``side, column, quantile``.

    One counting pass: values below a column's bracket count as -inf, those above as inf, so only what lies inside
    is shuffled and sorted. A bracket that misses the median shows as an infinite result and is opened.
    """
    rows = None
    for (side, column), near in brackets.items():
        hit, v = (F.col("side") == side) & (F.col("column") == column), F.col("value")
        if near is None:
            cut = v
        else:
            cut = F.when(v < near[0], float("-inf")).when(v > near[1], float("inf")).otherwise(v)
        rows = F.when(hit, cut) if rows is None else rows.when(hit, cut)
    counted = long.where(F.col("value").isNotNull()).withColumn("value", rows)
    counted = counted.groupBy("side", "column", "value").agg(F.sum("n").alias("n"))
    found = materialize(exact_quantiles(counted, ["side", "column"], "value", [0.5], "n"))
    missed = found.where(F.isnan("quantile") | (F.abs("quantile") == float("inf"))).select("side", "column").collect()
    wider = {(r["side"], r["column"]): None for r in missed if brackets[r["side"], r["column"]] is not None}
    if not wider:
        return found
    again = reduce(lambda x, y: x | y, [(F.col("side") == a) & (F.col("column") == b) for a, b in wider])
    return found.where(~again).unionByName(_selected(long.where(again), wider))


def medians(sides: dict[str, DataFrame], cols: list[str], accuracy: int | None = None) -> DataFrame:
    """Exact median per column, one output column per side; with ``accuracy`` the one-pass approximation."""
    if accuracy:
        out = None
        for name, df in sides.items():
            parts = [
                F.struct(F.lit(c).alias("column"), F.percentile_approx(c, 0.5, accuracy).alias(name))
                for c in cols
            ]
            one = numbers(df, cols).agg(F.array(*parts).alias("__s")).select(F.inline("__s"))
            out = one if out is None else out.join(one, "column")
        return out
    brackets = {}
    for name, df in sides.items():
        row = numbers(df, cols).agg(*[_near(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        brackets |= {(name, c): row[f"b{i}"] for i, c in enumerate(cols)}
    return _medians(sides, cols, brackets)


def _medians(sides: dict[str, DataFrame], cols: list[str], brackets: dict) -> DataFrame:
    parts = [
        melt(numbers(df, cols), cols, "double").select("*", F.lit(name).alias("side"), F.lit(1).cast("long").alias("n"))
        for name, df in sides.items()
    ]
    found = _selected(reduce(DataFrame.unionByName, parts), brackets)
    return found.groupBy("column").agg(
        *[F.max(F.when(F.col("side") == n, F.col("quantile"))).alias(n) for n in sides]
    )


def _paired(o: DataFrame, s: DataFrame, cols: list[str], near: bool = False) -> DataFrame:
    a = column_stats(o, cols, near)
    b = column_stats(s, cols, near)
    b = b.select("column", *[F.col(c).alias(f"{c}_s") for c in b.columns if c != "column"])
    return a.join(b, "column")


def _brackets(stats: list) -> dict:
    """From one row per column, as ``_paired`` gives them."""
    return {(side, r["column"]): r[c] for r in stats for side, c in (("median", "near"), ("median_s", "near_s"))}


def _similar(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    known = (hi > lo) & a.isNotNull() & b.isNotNull()  # greatest() would skip a NULL
    return F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(a - b) / (hi - lo)))


def _long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    parts = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
    return df.select("column", F.inline(F.array(*parts)))


def statistic_similarity(
    o: DataFrame, s: DataFrame, cols: list[str], stats=("mean", "median", "std"), accuracy=None
) -> DataFrame:
    """1 - |difference of a statistic| / range of the original, per column: ``column, metric, value``."""
    exact = "median" in stats and not accuracy
    pair = _paired(o, s, cols, near=exact)
    if exact:
        found = pair.collect()  # one row per column
        pair = o.sparkSession.createDataFrame(found, pair.schema)
        pair = pair.join(_medians({"median": o, "median_s": s}, cols, _brackets(found)), "column", "left")
    elif "median" in stats:
        pair = pair.join(medians({"median": o, "median_s": s}, cols, accuracy), "column", "left")
    return _long(pair, _similarities(stats))


def _similarities(stats) -> dict[str, Column]:
    return {
        f"{st}_similarity": _similar(F.col(st), F.col(f"{st}_s"), F.col("lo"), F.col("hi")) for st in stats
    }


def _range_coverage() -> Column:
    span = F.col("hi") - F.col("lo")
    low = F.greatest((F.col("lo_s") - F.col("lo")) / span, F.lit(0.0))
    high = F.greatest((F.col("hi") - F.col("hi_s")) / span, F.lit(0.0))
    covered = F.greatest(F.lit(0.0), 1 - (low + high))
    return F.when((span > 0) & F.col("lo_s").isNotNull(), covered)


def range_coverage(o: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
    """Share of the original's range that the synthetic values span; NULL for a single-valued original."""
    return _long(_paired(o, s, cols), {"range_coverage": _range_coverage()})


def boundary_adherence(o: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
    """Share of non-null synthetic values inside the original's range."""
    ranges = numbers(o, cols).agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)],
    )
    inside = numbers(s, cols).select(
        *[
            F.col(c)
            .between(ranges.select(f"lo_{i}").scalar(), ranges.select(f"hi_{i}").scalar())
            .cast("double")
            .alias(f"in_{i}")
            for i, c in enumerate(cols)
        ]
    )
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.lit("boundary_adherence").alias("metric"), F.avg(f"in_{i}").alias("value")
        )
        for i, c in enumerate(cols)
    ]
    return inside.agg(F.array(*parts).alias("__s")).select(F.inline("__s"))


def _numbered(df: DataFrame, cols: list[str]) -> DataFrame:
    """Dates and timestamps as their number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    dated = [c for c in cols if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: as_number(df, c) for c in dated}) if dated else df


def _as_text(df: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as text that is equal for equal values of the other side; dates and timestamps as their number."""
    mine, theirs = _numbered(df, cols), _numbered(other, cols)
    return mine.select(*[text.alias(c) for c, text in texts_of(mine, theirs, cols).items()])


def value_profile(o: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per (column, value) on each side, a NULL being one value."""
    sides = [
        melt(_as_text(df, other, cols), cols, "string").select("*", F.lit(i).alias("o"), F.lit(1 - i).alias("s"))
        for df, other, i in ((o, s, 1), (s, o, 0))
    ]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("column", "value").agg(F.sum("o").alias("o"), F.sum("s").alias("s"))


def _profile_medians(profile: DataFrame, cols: list[str], brackets: dict) -> DataFrame:
    """Exact medians of both sides from the value counts: ``column, median, median_s``."""
    sides = [F.struct(F.lit(name).alias("side"), F.col(x).alias("n")) for name, x in (("median", "o"), ("median_s", "s"))]
    long = profile.filter(F.col("column").isin(*cols)).select(
        "column", F.col("value").cast("double").alias("value"), F.inline(F.array(*sides))
    )
    found = _selected(long.filter(F.col("n") > 0), brackets)
    return found.groupBy("column").agg(
        *[F.max(F.when(F.col("side") == x, F.col("quantile"))).alias(x) for x in ("median", "median_s")]
    )


def _profile_adherence(profile: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Boundary adherence from the value counts; ``bounds`` has one entry per column."""
    v, inside = F.col("value").cast("double"), None
    for c, (lo, hi) in bounds.items():
        hit, ok = F.col("column") == c, v.between(lo, hi) if lo is not None else F.lit(None).cast("boolean")
        inside = F.when(hit, ok) if inside is None else inside.when(hit, ok)
    known = profile.filter(F.col("column").isin(*bounds) & F.col("value").isNotNull() & (F.col("s") > 0))
    share = F.sum(F.when(inside, F.col("s")).otherwise(0)) / F.sum("s")
    return known.groupBy("column").agg(share.alias("value")).select(
        "column", F.lit("boundary_adherence").alias("metric"), "value"
    )


def category_coverage(o: DataFrame, s: DataFrame, cols: list[str], profile: DataFrame | None = None) -> DataFrame:
    """Share of the original's categories that occur in the synthetic column."""
    prof = value_profile(o, s, cols) if profile is None else profile.filter(F.col("column").isin(*cols))
    known = prof.filter(F.col("value").isNotNull() & (F.col("o") > 0))
    return known.groupBy("column").agg(F.avg((F.col("s") > 0).cast("double")).alias("value")).select(
        "column", F.lit("category_coverage").alias("metric"), "value"
    )


def tv_complement(o: DataFrame, s: DataFrame, cols: list[str], profile: DataFrame | None = None) -> DataFrame:
    """1 - half the summed difference of the value shares; NULL when a side has no rows."""
    prof = value_profile(o, s, cols) if profile is None else profile.filter(F.col("column").isin(*cols))
    prof = materialize(prof) if profile is None else prof
    # every column has as many profiled rows as its side has rows
    sizes = prof.groupBy("column").agg(F.sum("o").alias("o"), F.sum("s").alias("s"))
    n_o = sizes.agg(F.max("o").alias("n")).scalar()
    n_s = sizes.agg(F.max("s").alias("n")).scalar()
    p_o, p_s = F.when(n_o > 0, F.col("o") / n_o), F.when(n_s > 0, F.col("s") / n_s)
    shares = prof.select("column", F.abs(p_o - p_s).alias("d"))
    return shares.groupBy("column").agg((1 - F.sum("d") / 2).alias("value")).select(
        "column", F.lit("frequency_similarity").alias("metric"), "value"
    )


def _null_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    parts = [
        F.struct(F.lit(c).alias("column"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("rate"))
        for c in cols
    ]
    return df.agg(F.array(*parts).alias("__s")).select(F.inline("__s"))


def missing_similarity(o: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
    """1 - |difference of the NULL shares|."""
    b = _null_rates(s, cols).withColumnRenamed("rate", "rate_s")
    return _long(
        _null_rates(o, cols).join(b, "column"),
        {"missing_similarity": 1 - F.abs(F.col("rate") - F.col("rate_s"))},
    )


def structural_report(o: DataFrame, s: DataFrame, roles, dataset: str, method: str) -> DataFrame:
    """Every single-column metric for the columns its role calls for, as one long table.

    Each side is read twice: once for the statistics of all columns and once for
    the value counts, from which medians, boundaries, shares and categories follow.
    """
    ranged = [*roles.datetime, *roles.continuous]
    named = [*roles.categorical, *roles.boolean]
    profile = materialize(value_profile(o, s, [*ranged, *named]))
    totals = profile.groupBy("column").agg(
        *[F.sum(x).alias(f"rows_{x}") for x in ("o", "s")],
        *[F.sum(F.when(F.col("value").isNull(), F.col(x)).otherwise(0)).alias(f"nulls_{x}") for x in ("o", "s")],
    )

    def rate(x):
        return F.when(F.col(f"rows_{x}") > 0, F.col(f"nulls_{x}") / F.col(f"rows_{x}"))

    parts = [_long(totals, {"missing_similarity": 1 - F.abs(rate("o") - rate("s"))})]
    if ranged:
        pair = _paired(o, s, ranged, near=True)
        stats = pair.collect()  # one row per column
        pair = o.sparkSession.createDataFrame(stats, pair.schema)
        bounds = {r["column"]: (r["lo"], r["hi"]) for r in stats}
        pair = pair.join(_profile_medians(profile, ranged, _brackets(stats)), "column", "left")
        parts += [
            _long(pair, {**_similarities(("mean", "median", "std")), "range_coverage": _range_coverage()}),
            _profile_adherence(profile, bounds),
            tv_complement(o, s, ranged, profile),
        ]
    if named:
        parts.append(category_coverage(o, s, named, profile))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), "metric", "column", "value")


def _assembled(df: DataFrame, cols: list[str], shift=None) -> DataFrame:
    nums = numbers(df, cols).dropna()
    if shift is not None:
        nums = nums.select(*[((F.col(c) - m) / sd).alias(c) for c, (m, sd) in shift.items()])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(nums)


def _one_gaussian(df: DataFrame, cols: list[str], shift, n: int):
    """The single-component fit: sample mean and covariance of the standardised rows."""
    rows = numbers(df, cols).dropna().select(*[((F.col(c) - m) / sd).alias(c) for c, (m, sd) in shift.items()])
    got = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)],
    ).first()
    d = len(cols)
    mean = np.array([[got[f"m{i}"] for i in range(d)]])
    cov = np.array([[[got[f"c{i}_{j}"] for j in range(d)] for i in range(d)]])
    sign, log_det = np.linalg.slogdet(cov[0] + 1e-9 * np.eye(d))
    return -0.5 * n * (d * np.log(2 * np.pi) + log_det + d), np.array([1.0]), mean, cov


def mixture_loglik(
    o: DataFrame, s: DataFrame, cols: list[str], k_candidates=(1, 2, 3), seed: int = 1, max_iter: int = 50
) -> DataFrame:
    """Mean log-likelihood of the synthetic rows under a Gaussian mixture fitted to the original.

    The number of components is the candidate with the smallest BIC. Columns are
    standardised for the fit; the log-likelihood is reported in original units.
    """
    stats = column_stats(o, cols).collect()  # one row per column
    shift = {r["column"]: (r["mean"], r["std"] or 1.0) for r in stats}
    shift = {c: shift[c] for c in cols}
    fit_rows = read = _assembled(o, cols, shift).select("features").persist()
    try:
        n, d = read.count(), len(cols)
        tasks = -(-n // STEP_ROWS)
        if read.rdd.getNumPartitions() < tasks:
            # a pass for each of up to max_iter steps: a file of few row groups would be one task's work every time
            fit_rows = read.repartition(tasks).persist()
        fits = []
        for k in k_candidates:
            if k == 1:
                fits.append(_one_gaussian(o, cols, shift, n))
                continue
            model = GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(fit_rows)
            means = np.array([g.mean.toArray() for g in model.gaussians])
            covs = np.array([g.cov.toArray() for g in model.gaussians])
            fits.append((model.summary.logLikelihood, np.asarray(model.weights), means, covs))
    finally:
        fit_rows.unpersist()
        read.unpersist()

    def bic(fit):
        k = len(fit[1])
        free = (k - 1) + k * d + k * d * (d + 1) / 2
        return free * np.log(n) - 2 * fit[0]

    _, weights, means, covs = min(fits, key=bic)
    k, covs = len(weights), covs + 1e-9 * np.eye(d)
    jacobian = -float(np.sum(np.log([sd for _, sd in shift.values()])))

    @F.pandas_udf("double")
    def log_density(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        per = np.empty((len(x), len(weights)))
        for i, (w, mu, cov) in enumerate(zip(weights, means, covs)):
            chol = np.linalg.cholesky(cov)
            z = np.linalg.solve(chol, (x - mu).T)
            log_det = np.log(np.diag(chol)).sum()
            per[:, i] = np.log(w) - 0.5 * (z**2).sum(axis=0) - log_det - 0.5 * x.shape[1] * np.log(2 * np.pi)
        top = per.max(axis=1)
        return pd.Series(top + np.log(np.exp(per - top[:, None]).sum(axis=1)) + jacobian)

    scaled = numbers(s, cols).dropna().select(*[((F.col(c) - m) / sd).alias(c) for c, (m, sd) in shift.items()])
    return scaled.select(log_density(*[F.col(c) for c in cols]).alias("ll")).agg(
        F.max(F.lit(int(k))).alias("components"), F.avg("ll").alias("mean_log_likelihood"), F.count(F.lit(1)).alias("rows")
    )
