"""Strength of association between pairs of columns of any kind.

All pairs share one pass: a row is expanded to its pairs, and map-side combine
shrinks them to distinct value pairs before the shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.values import value_text
from twinlake.operators.joins import null_safe
from twinlake.sources.scratch import materialize

SALTS = 16
FEW_TOTALS = 10_000


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, from a single aggregate: ``x, y, value``."""
    parts = []
    for a, b in combinations(cols, 2):
        r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        for x, y in ((a, b), (b, a)):
            parts.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("value")))
    parts += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("value")) for c in cols]
    return df.agg(F.array(*parts).alias("__s")).select(F.inline("__s"))


def joint_counts(df: DataFrame, pairs: list[tuple[str, str]], nulls: str = "category") -> DataFrame:
    """Rows per pair of values: ``x, y, vx, vy, n``. A NULL is a category or, with 'drop', leaves the pair out."""
    parts = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            value_text(df, a).alias("vx"),
            value_text(df, b).alias("vy"),
        )
        for a, b in pairs
    ]
    long = df.select(F.inline(F.array(*parts)))
    if nulls == "drop":
        long = long.dropna(subset=["vx", "vy"])
    return long.groupBy("x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("n"))


def _with_marginals(cells: DataFrame) -> DataFrame:
    """Add the row total ``r`` and column total ``c`` to each cell.

    The totals are written, so Spark broadcasts them where they are small. Where
    there are many, the cells of one value are dealt to SALTS tasks.
    """
    for v, other, total in (("vx", "vy", "r"), ("vy", "vx", "c")):
        side = cells.groupBy(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(v).alias("__v"))
        side = materialize(side.agg(F.sum("n").alias(total)))
        keys = [("x", "__x"), ("y", "__y"), (v, "__v")]
        if side.count() > FEW_TOTALS:
            side = side.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            cells = cells.withColumn("__salt", F.pmod(F.hash(other), F.lit(SALTS)))
            keys.append(("__salt", "__s"))
        cells = cells.join(side, null_safe(cells, side, keys)).drop("__x", "__y", "__v", "__s", "__salt")
    return cells


def cramers_v_table(cells: DataFrame) -> DataFrame:
    """Bias-corrected Cramér's V per pair of a joint count table; NULL for a single-valued column."""
    got = _with_marginals(cells).groupBy("x", "y").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n") / F.col("r") / F.col("c")).alias("q"),
    )
    rows = cells.groupBy("x", "y", "vx").agg(F.lit(1).alias("one")).groupBy("x", "y").agg(F.count("one").alias("a"))
    cols = cells.groupBy("x", "y", "vy").agg(F.lit(1).alias("one")).groupBy("x", "y").agg(F.count("one").alias("b"))
    got = got.join(rows, ["x", "y"]).join(cols, ["x", "y"])
    n, a, b = (F.col(c).cast("double") for c in ("n", "a", "b"))
    phi2 = F.greatest(F.lit(0.0), F.col("q") - 1 - (a - 1) * (b - 1) / (n - 1))
    a_fix = a - (a - 1) * (a - 1) / (n - 1)
    b_fix = b - (b - 1) * (b - 1) / (n - 1)
    low = F.least(a_fix, b_fix) - 1
    return got.select("x", "y", F.when((n > 1) & (low > 0), F.sqrt(phi2 / low)).alias("value"))


def theils_u_table(cells: DataFrame) -> DataFrame:
    """U(x|y) and U(y|x) per pair of a joint count table, as two directed rows."""
    marked = _with_marginals(cells)
    n_of = cells.groupBy("x", "y").agg(F.sum("n").alias("__n"))
    marked = marked.join(n_of, ["x", "y"])
    p = F.col("n") / F.col("__n")
    # each cell carries its share of the marginal entropies
    h_x = -F.sum(p * F.log(F.col("r") / F.col("__n")))
    h_y = -F.sum(p * F.log(F.col("c") / F.col("__n")))
    h_x_y = -F.sum(p * F.log(F.col("n") / F.col("c")))
    h_y_x = -F.sum(p * F.log(F.col("n") / F.col("r")))
    got = marked.groupBy("x", "y").agg(
        h_x.alias("hx"), h_y.alias("hy"), h_x_y.alias("hxy"), h_y_x.alias("hyx")
    )

    def u(h: str, rest: str) -> Column:
        return F.when(F.col(h) <= 1e-15, F.lit(1.0)).otherwise((F.col(h) - F.col(rest)) / F.col(h))

    both = F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y"), u("hx", "hxy").alias("value")),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y"), u("hy", "hyx").alias("value")),
    )
    return got.select(F.inline(both))


def cramers_v(df: DataFrame, a: str, b: str, nulls: str = "category") -> DataFrame:
    return cramers_v_table(materialize(joint_counts(df, [(a, b)], nulls)))


def theils_u(df: DataFrame, a: str, b: str, nulls: str = "category") -> DataFrame:
    return theils_u_table(materialize(joint_counts(df, [(a, b)], nulls)))


def correlation_ratio(df: DataFrame, categories: list[str], numerics: list[str], nulls: str = "category") -> DataFrame:
    """Correlation ratio of every (category, number) pair: ``x`` category, ``y`` number, ``value``.

    A NULL category is a category. NULL numbers count as 0, or with 'drop' (as
    NULL categories then do) leave the row out of the pair.
    """
    nums = [F.struct(F.lit(c).alias("y"), F.col(f"`{c}`").cast("double").alias("w")) for c in numerics]
    cats = [F.struct(F.lit(c).alias("x"), F.col(f"`{c}`").cast("string").alias("v")) for c in categories]
    long = df.select(F.array(*nums).alias("__n"), F.inline(F.array(*cats))).select("x", "v", F.inline("__n"))
    if nulls == "drop":
        long = long.dropna(subset=["v", "w"])
    else:
        long = long.fillna(0.0, subset=["w"])
    groups = materialize(
        long.groupBy("x", "v", "y").agg(
            F.count(F.lit(1)).alias("n"), F.avg("w").alias("m"), (F.var_pop("w") * F.count("w")).alias("within")
        )
    )
    centre = groups.groupBy("x", "y").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    gap = F.col("m") - F.col("mean")
    parts = groups.join(centre, ["x", "y"]).groupBy("x", "y").agg(
        F.sum(F.col("n") * gap * gap).alias("between"), F.sum("within").alias("within")
    )
    total = F.col("between") + F.col("within")
    value = F.when(total > 0, F.sqrt(F.col("between") / total)).otherwise(0.0)
    return parts.select("x", "y", value.alias("value"))


def association_matrix(
    df: DataFrame, nominal: list[str], numeric: list[str], measure: str = "cramer", nulls: str = "category"
) -> DataFrame:
    """Every ordered pair of columns: ``x, y, value``.

    Two nominal columns: Cramér's V or, directed, Theil's U. Nominal and
    numeric: the correlation ratio. Two numeric: Pearson.
    """
    if measure not in ("cramer", "theil"):
        raise ValueError("measure is 'cramer' or 'theil'")
    out = df.sparkSession.createDataFrame([(c, c, 1.0) for c in nominal], "x string, y string, value double")
    pairs = list(combinations(nominal, 2))
    if pairs:
        cells = materialize(joint_counts(df, pairs, nulls))
        if measure == "theil":
            out = out.unionByName(theils_u_table(cells))
        else:
            out = out.unionByName(_both_ways(cramers_v_table(cells)))
    if nominal and numeric:
        out = out.unionByName(_both_ways(correlation_ratio(df, nominal, numeric, nulls)))
    if numeric:
        nums = df.select(*numeric)
        out = out.unionByName(corr_matrix(nums if nulls == "drop" else nums.fillna(0), numeric))
    return out


def _both_ways(df: DataFrame) -> DataFrame:
    flipped = F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "value")
    return df.select(F.inline(F.array(F.struct("x", "y", "value"), flipped)))


def association_difference(o: DataFrame, s: DataFrame, nominal, numeric, measure="cramer", nulls="category") -> DataFrame:
    """The association matrix of both sides and their absolute difference."""
    a = association_matrix(o, nominal, numeric, measure, nulls).withColumnRenamed("value", "original")
    b = association_matrix(s, nominal, numeric, measure, nulls).withColumnRenamed("value", "synthetic")
    return a.join(b, ["x", "y"]).withColumn("difference", F.abs(F.col("original") - F.col("synthetic")))
