"""Contingency tables and their comparison across two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize


def _label(cols: list[str]) -> Column:
    if len(cols) == 1:
        return F.col(f"`{cols[0]}`").cast("string")
    # escape the separator so that two different tuples never share a label
    parts = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"([|\\])", r"\\$1") for c in cols]
    return F.concat_ws("|", *parts)


def crosstab(df: DataFrame, row: str, cols: list[str], fmt: str = "long") -> DataFrame:
    """Rows per (row value, column values), NULL keys left out.

    Long lists the observed cells; wide has one zero-filled column per observed tuple.
    """
    known = df.dropna(subset=[row, *cols])
    cells = known.groupBy(row, *cols).agg(F.count(F.lit(1)).alias("n"))
    if fmt == "long":
        return cells
    if fmt != "wide":
        raise ValueError("fmt is 'long' or 'wide'")
    cells = materialize(cells.select(row, _label(cols).alias("__label"), "n"))
    labels = [r[0] for r in cells.select("__label").distinct().collect()]  # the columns of the result
    return cells.groupBy(row).pivot("__label", sorted(labels)).agg(F.sum("n")).fillna(0)


def compare_crosstab(orig: DataFrame, syn: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Counts and shares of every cell on both sides, from one aggregation of the union."""
    keys = [row, *cols]
    sides = [
        df.dropna(subset=keys).select(*keys, F.lit(o).alias("__o"), F.lit(1 - o).alias("__s"))
        for df, o in ((orig, 1), (syn, 0))
    ]
    both = sides[0].unionByName(sides[1])
    cells = materialize(both.groupBy(*keys).agg(F.sum("__o").alias("n_original"), F.sum("__s").alias("n_synthetic")))
    total = cells.agg(F.sum("n_original").alias("o"), F.sum("n_synthetic").alias("s"))

    def share(count, side):
        n = total.select(side).scalar()
        return F.when(n > 0, F.col(count) / n)

    return cells.withColumns(
        {"share_original": share("n_original", "o"), "share_synthetic": share("n_synthetic", "s")}
    )


def crosstab_distance(compared: DataFrame) -> DataFrame:
    """Total variation distance of the two sides of a compared crosstab."""
    return compared.agg(
        (F.sum(F.abs(F.col("share_original") - F.col("share_synthetic"))) / 2).alias("distance"),
        F.count(F.lit(1)).alias("cells"),
    )
