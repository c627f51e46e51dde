"""Shared pieces of the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions.rand import below, uniform

SEED = 7
Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Queries and SQL checks registered under the same key."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_sql(stream: str, key: str, seed=SEED) -> str:
    return (
        f"(('0x'||substr(md5('{seed}:{stream}:'||cast({key} as varchar)),1,13))::BIGINT::DOUBLE"
        "/4503599627370496.0)"
    )


def bin_sql(col: str, edges, labels=None) -> str:
    labels = range(1, len(edges)) if labels is None else labels
    arms = [f"WHEN {col} <= {edges[0]} THEN NULL"]
    for hi, label in zip(edges[1:], labels):
        shown = f"'{label}'" if isinstance(label, str) else str(label)
        arms.append(f"WHEN {col} <= {hi} THEN {shown}")
    return "CASE " + " ".join(arms) + " END"


def weighted_sql(u: str, values: dict) -> str:
    from twinlake.functions.rand import normalise

    cuts = normalise(values.values())
    picks = list(values)
    arms = [f"WHEN {u} < {c!r} THEN '{v}'" for v, c in zip(picks[:-1], cuts[:-1])]
    return "CASE " + " ".join(arms) + f" ELSE '{picks[-1]}' END"


BALANCE_EDGES = [-1000, 0, 2500, 5000, 7500, 10000]
BALANCE_LABELS = ["<=0", "0-2500", "2500-5000", "5000-7500", ">7500"]


def customer_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-alike of ``customer`` with leaks, NULLs, noise and an unseen segment."""
    k = "c_custkey"

    def u(stream):
        return uniform(SEED, stream, k)

    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(u("nm") < 0.1, F.col("c_name")).otherwise(F.concat(F.lit("X"), "c_name")).alias("c_name"),
        F.pmod(F.col("c_nationkey") + below(u("nat"), 3).cast("int"), F.lit(25)).alias("c_nationkey"),
        F.when(u("nul") < 0.05, None)
        .otherwise(F.col("c_acctbal") * (0.8 + 0.4 * u("bal")))
        .alias("c_acctbal"),
        F.when(u("seg") < 0.2, "SYNTHETIC")
        .when(u("seg") < 0.3, None)
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


CUSTOMER_SYN = f"""customer_syn AS (
  SELECT c_custkey,
    CASE WHEN {u_sql('nm', 'c_custkey')} < 0.1 THEN c_name ELSE 'X' || c_name END AS c_name,
    CAST((c_nationkey + CAST(floor(3*{u_sql('nat', 'c_custkey')}) AS INTEGER)) % 25 AS INTEGER) AS c_nationkey,
    CASE WHEN {u_sql('nul', 'c_custkey')} < 0.05 THEN NULL
         ELSE c_acctbal * (0.8::DOUBLE + 0.4::DOUBLE * {u_sql('bal', 'c_custkey')}) END AS c_acctbal,
    CASE WHEN {u_sql('seg', 'c_custkey')} < 0.2 THEN 'SYNTHETIC'
         WHEN {u_sql('seg', 'c_custkey')} < 0.3 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LINE_KEY_SQL = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def lineitem_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-alike of ``lineitem``: three in ten parts swapped, ship dates shifted."""
    parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")).scalar()

    def u(stream):
        return uniform(SEED, stream, *LINE_KEY)

    line = table(spark, sf_dir, "lineitem")
    swapped = F.lit(1).cast("long") + F.floor(u("part") * 0.5 * parts)
    moved = F.floor(u("shift") * 60).cast("int") - 30
    return line.withColumns(
        {
            "l_partkey": F.when(u("swap") < 0.3, swapped).otherwise(F.col("l_partkey")),
            "l_shipdate": F.timestamp_add("DAY", moved, F.col("l_shipdate")),
        }
    )


LINEITEM_SYN = f"""lineitem_syn AS (
  SELECT * REPLACE (
    CASE WHEN {u_sql('swap', _LINE_KEY_SQL)} < 0.3
         THEN 1 + CAST(floor({u_sql('part', _LINE_KEY_SQL)} * 0.5::DOUBLE * (SELECT count(*) FROM part)) AS BIGINT)
         ELSE l_partkey END AS l_partkey,
    l_shipdate + to_days(CAST(floor({u_sql('shift', _LINE_KEY_SQL)} * 60) AS INTEGER) - 30) AS l_shipdate)
  FROM lineitem)"""
