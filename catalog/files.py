"""CSV round trips, folders, metadata, reports and streams over exports of the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from catalog.common import CUSTOMER_SYN, SEED, Family, customer_syn, table, u_sql
from twinlake.functions.rand import uniform
from twinlake.operators.aggregate import rounded
from twinlake.sources import report, tabular
from twinlake.sources.roles import Roles, check_roles
from twinlake.sources.scratch import shared_dir
from twinlake.streaming import steps

family = Family()
add = family.add


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add("src_csv_decimal_comma", "SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer")
def _(spark, d):
    path = fresh(spark, "export") + "/customer.csv"
    tabular.write_csv(table(spark, d, "customer"), path)
    back = tabular.read_csv(spark, path)
    return back.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")


@add(
    "src_folder_scan",
    """SELECT 'nation' AS dataset, count(*) AS rows, 3 AS columns FROM nation
       UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'orders', count(*), 3 FROM orders""",
)
def _(spark, d):
    folder = fresh(spark, "folder")
    tabular.write_csv(table(spark, d, "nation"), f"{folder}/nation.csv")
    tabular.write_csv(table(spark, d, "customer"), f"{folder}/customer.csv", sep="|")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tabular.write_csv(orders, f"{folder}/orders.csv", sep="\t", decimal=".")
    out = None
    for name, df in tabular.read_folder(spark, folder).items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        out = one if out is None else out.unionByName(one)
    return out


_META = {
    "columns": {
        "case_id": {"sdtype": "id", "regex_format": "C[0-9]{6}"},
        "amount": {"sdtype": "numerical"},
        "status": {"sdtype": "categorical"},
        "day": {"sdtype": "datetime", "datetime_format": "%d.%m.%Y"},
        "open": {"sdtype": "boolean"},
        "name": {"sdtype": "last_name", "pii": True},
    }
}


@add(
    "src_metadata_roles",
    f"""WITH t AS (SELECT {u_sql('bad', 'o_orderkey')} AS u, o_orderkey, o_totalprice FROM orders)
        SELECT 'case_id' AS "column", count(*) FILTER (o_orderkey > 999999 OR u < 0.1) AS invalid, count(*) AS filled FROM t
        UNION ALL SELECT 'amount', count(*) FILTER (u >= 0.1 AND u < 0.2), count(*) FROM t
        UNION ALL SELECT 'status', 0, count(*) FROM t
        UNION ALL SELECT 'day', count(*) FILTER (u >= 0.2 AND u < 0.3), count(*) FROM t
        UNION ALL SELECT 'open', count(*) FILTER (u >= 0.3 AND u < 0.4), count(*) FROM t
        UNION ALL SELECT 'name', 0, count(*) FROM t""",
)
def _(spark, d):
    path = fresh(spark, "metadata")
    spark.createDataFrame([(json.dumps(_META),)], "value string").coalesce(1).write.text(path)
    roles = Roles.from_json(spark, path)
    u = uniform(SEED, "bad", "o_orderkey")
    number = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    number = F.when(F.col("o_orderkey") > 999999, "too long").otherwise(number)
    df = table(spark, d, "orders").select(
        F.concat(F.when(u < 0.1, "c").otherwise("C"), number).alias("case_id"),
        F.when(u.between(0.1, 0.2), "n/a").otherwise(F.regexp_replace(F.col("o_totalprice").cast("string"), r"\.", ",")).alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.when(u.between(0.2, 0.3), "31.02.2020").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day"),
        F.when(u.between(0.3, 0.4), "maybe").otherwise("true").alias("open"),
        F.lit("Huber").alias("name"),
    )
    return check_roles(df, roles)


@add(
    "snk_roundtrip",
    f"""WITH {CUSTOMER_SYN} SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
        round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer_syn""",
)
def _(spark, d):
    path = fresh(spark, "roundtrip") + "/customer.csv"
    tabular.write_csv(customer_syn(spark, d), path)
    return rounded(tabular.read_csv(spark, path, sep=";", encoding="UTF-8"))


@add(
    "snk_report_sections",
    """SELECT 'segments' AS section, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL
       UNION ALL SELECT 'nations', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL""",
)
def _(spark, d):
    path = fresh(spark, "report")
    c = table(spark, d, "customer")
    first = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    second = c.groupBy(F.col("c_nationkey").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    report.write_report(first.limit(1), path, "segments")
    report.write_report(second, path, "nations")
    report.write_report(first, path, "segments", mode="overwrite")
    return report.read_report(spark, path).select("section", "label", "n")


@add(
    "src_pair_files",
    """SELECT * FROM (VALUES ('cust_omer', 'noise'), ('cust_omer', 'tree'), ('nation', 'tree')) t(dataset, method),
       (SELECT count(*) AS rows FROM customer) WHERE dataset = 'cust_omer'
       UNION ALL SELECT 'nation', 'tree', count(*) FROM nation""",
)
def _(spark, d):
    orig, syn = fresh(spark, "original"), fresh(spark, "synthetic")
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    tabular.write_csv(customer, f"{orig}/cust_omer.csv")
    tabular.write_csv(nation, f"{orig}/nation.csv")
    tabular.write_csv(customer_syn(spark, d), f"{syn}/noise_cust_omer.csv")
    tabular.write_csv(customer, f"{syn}/tree_cust_omer.csv")
    tabular.write_csv(nation, f"{syn}/tree_nation.csv")
    out = None
    for r in tabular.pair_datasets(spark, orig, syn).collect():  # one row per file
        rows = tabular.read_csv(spark, r["synthetic"]).agg(F.count(F.lit(1)).alias("rows"))
        one = rows.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["method"]).alias("method"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_STEPS = [
    {"op": "drop", "cols": ["props"]},
    {"op": "date", "cols": ["ts"], "level": "month_year"},
    {"op": "pseudonymize", "col": "user_id", "method": "hash"},
    {"op": "bin", "col": "value", "edges": [-1000000, 0, 50, 100, 1000000], "labels": ["neg", "low", "mid", "high"]},
]


@add(
    "stream_row_steps",
    f"""SELECT event_id, strftime(ts, '%B %Y') AS ts, event_type,
          md5('{SEED}:pseudonym:' || user_id) AS user_id,
          CASE WHEN value <= -1000000 THEN NULL WHEN value <= 0 THEN 'neg' WHEN value <= 50 THEN 'low'
               WHEN value <= 100 THEN 'mid' WHEN value <= 1000000 THEN 'high' END AS value FROM events""",
)
def _(spark, d):
    stream = steps.stream_files(spark, d, table(spark, d, "events").schema, "events.parquet")
    out = steps.apply_steps(stream, _STEPS, SEED)
    path = fresh(spark, "stream")
    steps.run_available(out, f"{path}/rows", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@add(
    "stream_leak_check",
    "SELECT event_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS in_original FROM events",
)
def _(spark, d):
    stream = steps.stream_files(spark, d, table(spark, d, "events").schema, "events.parquet")
    known = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    out = steps.leak_flags(stream.select("event_id", "user_id"), known, ["user_id"]).drop("user_id")
    path = fresh(spark, "stream")
    steps.run_available(out, f"{path}/rows", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
