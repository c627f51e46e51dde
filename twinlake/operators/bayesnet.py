"""Bayesian networks over a fixed graph: conditional tables by counting, sampling by joins."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.rand import uniform
from twinlake.operators.aggregate import prevalence
from twinlake.operators.association import corr_matrix
from twinlake.operators.draw import draw_weighted, value_counts
from twinlake.operators.joins import attach
from twinlake.operators.rank import global_cumulative
from twinlake.sources.scratch import materialize


class BayesNet:
    """A directed acyclic graph of columns and, once fitted, a count table per column."""

    def __init__(self, edges: list[tuple[str, str]], nodes: list[str] | None = None):
        names = list(dict.fromkeys([*(nodes or []), *[n for e in edges for n in e]]))
        self.parents = {n: [a for a, b in edges if b == n] for n in names}
        try:
            self.order = list(TopologicalSorter(self.parents).static_order())
        except CycleError as err:
            raise ValueError("the graph has a cycle") from err
        self.counts: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> "BayesNet":
        """Count every (parents, value) combination; rows with a NULL in them are left out."""
        for node, parents in self.parents.items():
            known = df.dropna(subset=[*parents, node])
            self.counts[node] = materialize(value_counts(known, parents, node))
        return self

    def cpd(self, node: str) -> DataFrame:
        """Conditional probabilities of a column: parents, value, ``_n`` rows, ``_p`` and running ``_cum``."""
        parents, counts = self.parents[node], self.counts[node]
        ranked, _, _ = global_cumulative(counts, [*parents, node], "__n")
        ranked = materialize(ranked.withColumnRenamed("cum", "__run").drop("rank", "cum_cum"))
        spans = ranked.groupBy(*parents).agg(
            F.min(F.col("__run") - F.col("__n")).alias("__before"), F.sum("__n").alias("__total")
        )
        if parents:
            placed = attach(ranked, spans, parents)
        else:
            whole = spans.select("__total").scalar()
            placed = ranked.withColumns({"__before": F.lit(0), "__total": whole})
        return placed.select(
            *parents,
            node,
            F.col("__n").alias("_n"),
            (F.col("__n") / F.col("__total")).alias("_p"),
            ((F.col("__run") - F.col("__before")) / F.col("__total")).alias("_cum"),
        )

    def cpd_table(self) -> DataFrame:
        """All conditional tables as one long table with text states."""
        out = None
        for node in self.order:
            parents = self.parents[node]
            state = F.concat_ws(",", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in sorted(parents)])
            one = self.cpd(node).select(
                F.lit(node).alias("node"),
                state.alias("given"),
                F.col(node).cast("string").alias("value"),
                F.col("_n").alias("n"),
                F.col("_p").alias("p"),
                F.col("_cum").alias("cum"),
            )
            out = one if out is None else out.unionByName(one)
        return out

    def check(self) -> DataFrame:
        """Conditional distributions that do not sum to 1 (none, when the model is sound)."""
        sums = self.cpd_table().groupBy("node", "given").agg(F.sum("p").alias("total"))
        return sums.filter(F.abs(F.col("total") - 1) > 1e-9)

    def simulate(self, base: DataFrame, seed, key: str = "id") -> DataFrame:
        """One row of every column per base row, parents before children.

        A parent combination the fit never saw draws uniformly from the column's values.
        """
        df = base
        for node in self.order:
            parents = self.parents[node]
            u = uniform(seed, node, key)
            df = draw_weighted(df, self.counts[node], parents, node, u, node)
            if len(parents) > 1:
                levels = materialize(self.counts[node].select(node).distinct().withColumn("__n", F.lit(1)))
                df = draw_weighted(df, levels, [], node, uniform(seed, f"{node}/unseen", key), "__any")
                df = df.withColumn(node, F.coalesce(node, "__any")).drop("__any")
        return df


def compare_prevalence(orig: DataFrame, syn: DataFrame, by: list[str], flags: dict) -> DataFrame:
    """Prevalence per group on both sides; groups without cases on a side are missing there."""
    a = prevalence(orig, by, flags)
    b = prevalence(syn, by, flags)
    rest = [c for c in a.columns if c not in by]
    a = a.select(*by, *[F.col(c).alias(f"{c}_original") for c in rest])
    b = b.select(*by, *[F.col(c).alias(f"{c}_simulated") for c in rest])
    return a.join(b, by, "full")


def compare_correlation(orig: DataFrame, syn: DataFrame, cols: list[str]) -> DataFrame:
    a = corr_matrix(orig, cols).withColumnRenamed("value", "original")
    return a.join(corr_matrix(syn, cols).withColumnRenamed("value", "simulated"), ["x", "y"])
