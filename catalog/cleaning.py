"""Filters, projections, generalisation and basic aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    BALANCE_EDGES,
    BALANCE_LABELS,
    CUSTOMER_SYN,
    SEED,
    Family,
    bin_sql,
    customer_syn,
    table,
    u_sql,
)
from twinlake.functions import dates
from twinlake.functions import generalize as g
from twinlake.functions.rand import uniform
from twinlake.operators import aggregate, clean, joins
from twinlake.plans import examples as ex

family = Family()
add = family.add


@add("gen_drop_identifiers", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return clean.drop_identifiers(table(spark, d, "customer"), ["c_name"])


@add(
    "prj_select_rename",
    """SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal > 0 AS positive,
              c_name AS name FROM customer""",
)
def _(spark, d):
    df = clean.select_rename(
        table(spark, d, "customer"), [0, "c_name", "c_acctbal", 4], ["id", "name", "balance", "segment"]
    )
    df = df.withColumn("positive", F.col("balance") > 0).drop("balance")
    return clean.move_column(df, "positive", 1)


@add(
    "prj_recode",
    """SELECT o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'False' WHEN 'O' THEN 'True' END AS open_text,
         CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS code,
         CAST(o_custkey AS VARCHAR) AS cust_text
       FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    o = o.withColumns({"open_text": F.col("o_orderstatus"), "code": F.col("o_orderstatus")})
    o = clean.recode(o, "open_text", {"F": "False", "O": "True"})
    o = clean.recode(o, "code", {"F": 0, "O": 1})
    o = clean.recode(o.withColumnRenamed("o_orderstatus", "status"), "status", {"P": "pending"}, "keep")
    o = clean.cast_columns(o, {"o_custkey": "string", "code": "long"})
    return o.withColumnRenamed("o_custkey", "cust_text")


@add(
    "prj_conditional_pick",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority
              WHEN 'O' THEN CAST(o_custkey AS VARCHAR) END AS picked FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    pick = clean.coalesce_by(
        "o_orderstatus", {"F": "o_orderpriority", "O": F.col("o_custkey").cast("string")}
    )
    return o.select("o_orderkey", pick.alias("picked"))


@add(
    "prj_prefix_flag",
    """SELECT o_orderkey, coalesce(starts_with(
              CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '1'), false) AS urgent FROM orders""",
)
def _(spark, d):
    text = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", clean.has_prefix(text, "1").alias("urgent"))


@add(
    "prj_null_if",
    f"""WITH {CUSTOMER_SYN} SELECT c_custkey, nullif(c_mktsegment, 'SYNTHETIC') AS c_mktsegment,
        CASE WHEN c_nationkey NOT IN (0, 1) THEN c_nationkey END AS c_nationkey FROM customer_syn""",
)
def _(spark, d):
    df = customer_syn(spark, d).select("c_custkey", "c_mktsegment", "c_nationkey")
    return clean.null_if(df, {"c_mktsegment": ["SYNTHETIC"], "c_nationkey": [0, 1]})


@add(
    "prj_fill_sentinel",
    f"""WITH {CUSTOMER_SYN} SELECT c_custkey, round(coalesce(c_acctbal, 0), 6) AS c_acctbal,
        coalesce(c_mktsegment, '0') AS c_mktsegment FROM customer_syn""",
)
def _(spark, d):
    df = customer_syn(spark, d).select("c_custkey", "c_acctbal", "c_mktsegment")
    filled = clean.fill_sentinel(df, ["c_acctbal", "c_mktsegment"], 0)
    return filled.withColumn("c_acctbal", F.round("c_acctbal", 6))


@add(
    "prj_impute",
    f"""WITH {CUSTOMER_SYN},
      m AS (SELECT median(c_acctbal) AS bal FROM customer_syn),
      s AS (SELECT c_mktsegment AS seg FROM customer_syn WHERE c_mktsegment IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      SELECT c_custkey, round(coalesce(c_acctbal, (SELECT bal FROM m)), 6) AS c_acctbal,
             coalesce(c_mktsegment, (SELECT seg FROM s)) AS c_mktsegment FROM customer_syn""",
)
def _(spark, d):
    df = customer_syn(spark, d).select("c_custkey", "c_acctbal", "c_mktsegment")
    out = clean.impute(df, categorical=["c_mktsegment"], numeric=["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@add(
    "flt_isin",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
       WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F'""",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    hit = F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F")
    return line.filter(hit).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@add(
    "flt_suppress_patterns",
    """SELECT l_orderkey, l_partkey, l_linenumber, flag, l_linestatus
       FROM (SELECT *, nullif(l_returnflag, 'N') AS flag FROM lineitem)
       WHERE NOT coalesce((flag = 'R' AND l_linestatus = 'F') OR (flag = 'A' AND l_linenumber = 1), false)""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    line = line.select("l_orderkey", "l_partkey", "l_linenumber", "flag", "l_linestatus")
    return clean.suppress_patterns(
        line, [{"flag": "R", "l_linestatus": "F"}, {"flag": "A", "l_linenumber": 1}]
    )


_QTY = "CASE WHEN l_linenumber <> 7 THEN l_quantity - 10 END"


@add(
    "flt_positive_qty",
    f"""SELECT l_orderkey, l_partkey, qty FROM (SELECT *, {_QTY} AS qty FROM lineitem)
        WHERE qty > 0 OR qty IS NULL""",
)
def _(spark, d):
    qty = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - 10)
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", qty.alias("qty"))
    return clean.positive_only(line, "qty")


@add(
    "flt_dropna",
    f"""WITH {CUSTOMER_SYN} SELECT c_custkey, c_nationkey FROM customer_syn
        WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""",
)
def _(spark, d):
    df = customer_syn(spark, d).dropna(subset=["c_acctbal", "c_mktsegment"])
    return df.select("c_custkey", "c_nationkey")


@add(
    "gen_bin_numeric",
    f"""SELECT c_custkey, {bin_sql('c_acctbal', BALANCE_EDGES, BALANCE_LABELS)} AS balance_band,
        CAST({bin_sql('c_acctbal', BALANCE_EDGES)} AS INTEGER) AS band_rank,
        {bin_sql('(c_nationkey * 5)', g.AGE_EDGES, g.AGE_LABELS)} AS age_band FROM customer""",
)
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        g.bin_numeric("c_acctbal", BALANCE_EDGES, BALANCE_LABELS).alias("balance_band"),
        g.bin_numeric("c_acctbal", BALANCE_EDGES).alias("band_rank"),
        g.bin_numeric(F.col("c_nationkey") * 5, g.AGE_EDGES, g.AGE_LABELS).alias("age_band"),
    )


@add(
    "gen_age_from_date",
    "SELECT o_orderkey, CAST(2023 - year(o_orderdate) AS INTEGER) AS age FROM orders",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", g.age_from_birthdate("o_orderdate", 2023).alias("age"))


@add(
    "gen_date_levels",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%B %Y') AS month_year,
              strftime(ts, '%m') AS month, strftime(ts, '%Y') AS year FROM events""",
)
def _(spark, d):
    levels = [g.generalize_date("ts", lv).alias(lv) for lv in ("day", "month_year", "month", "year")]
    return table(spark, d, "events").select("event_id", *levels)


@add(
    "gen_season",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter'
         WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Frühling'
         WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Sommer' ELSE 'Herbst' END AS season FROM orders""",
)
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", g.season(F.month("o_orderdate")).alias("season"))


_CODE = "lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')"


@add(
    "gen_prefix",
    f"""SELECT p_partkey, CASE WHEN substr(code, 1, 1) IN ('1','2','3','4','5','7','8') THEN substr(code, 1, 1)
          WHEN substr(code, 1, 1) IN ('6', '9') THEN substr(code, 1, 2) ELSE code END AS area
        FROM (SELECT p_partkey, {_CODE} AS code FROM part)""",
)
def _(spark, d):
    code = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    return table(spark, d, "part").select("p_partkey", g.generalize_prefix(code).alias("area"))


# postcodes over the whole range
_POSTCODE = "CAST(1000 + p_partkey * 37 % 9000 AS VARCHAR)"
_RULES = ", ".join(f"('{p}', '{s}')" for s, ps in ex.STATE_PREFIXES.items() for p in ps)


@add(
    "join_prefix",
    f"""WITH rules(prefix, state) AS (VALUES {_RULES}), c AS (SELECT p_partkey, {_POSTCODE} AS code FROM part)
        SELECT p_partkey, code, state FROM c JOIN rules ON starts_with(code, prefix)""",
)
def _(spark, d):
    code = (1000 + F.col("p_partkey") * 37 % 9000).cast("string")
    codes = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return joins.prefix_join(codes, "code", ex.STATE_PREFIXES, "state")


@add(
    "prj_date_parts",
    """SELECT event_id, strftime(ts, '%B') AS ts_month, strftime(ts, '%A') AS ts_weekday,
          CAST(year(ts) AS INTEGER) AS ts_year, strftime(ts, '%d.%m.%Y') AS ts_date
       FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN ts END AS ts FROM events)""",
)
def _(spark, d):
    ts = F.when(F.col("event_type") != "click", F.col("ts"))
    df = table(spark, d, "events").select("event_id", ts.alias("ts"))
    return dates.derive_date_parts(df, {"ts": ["month", "weekday", "year", "date"]}).drop("ts")


@add(
    "prj_parse_dates",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN {u_sql('bad', 'o_orderkey')} < 0.05 THEN '31.02.2020'
            ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day_text,
            strftime(o_orderdate, '%d.%m.%Y %H:%M') AS time_text FROM orders)
        SELECT o_orderkey, strftime(try_strptime(day_text, '%d.%m.%Y'), '%Y-%m-%d') AS day_text,
               strftime(try_strptime(time_text, '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M') AS time_text FROM t""",
)
def _(spark, d):
    bad = uniform(SEED, "bad", "o_orderkey") < 0.05
    df = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(bad, "31.02.2020").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day_text"),
        F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("time_text"),
    )
    out = dates.parse_dates(df, {"day_text": "dd.MM.yyyy", "time_text": "dd.MM.yyyy HH:mm"})
    return out.select(
        "o_orderkey",
        F.date_format("day_text", "yyyy-MM-dd").alias("day_text"),
        F.date_format("time_text", "yyyy-MM-dd HH:mm").alias("time_text"),
    )


@add(
    "prj_assemble_date",
    f"""WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
             CASE WHEN {u_sql('day', 'o_orderkey')} < 0.05 THEN 31
                  WHEN {u_sql('day', 'o_orderkey')} < 0.1 THEN NULL
                  WHEN {u_sql('day', 'o_orderkey')} < 0.12 THEN 0 ELSE day(o_orderdate) END AS d FROM orders)
        SELECT o_orderkey, strftime(try_strptime(
             lpad(CAST(d AS VARCHAR), 2, '0') || '.' || lpad(CAST(m AS VARCHAR), 2, '0') || '.' || y,
             '%d.%m.%Y'), '%d.%m.%Y') AS o_orderdate FROM p""",
)
def _(spark, d):
    u = uniform(SEED, "day", "o_orderkey")
    o = dates.split_date(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    day = F.when(u < 0.05, 31).when(u < 0.1, None).when(u < 0.12, 0).otherwise(F.col("o_orderdate_day"))
    return dates.assemble_date(o.withColumn("o_orderdate_day", day), "o_orderdate")


@add(
    "prj_split_date",
    """SELECT event_id, CAST(day(ts) AS INTEGER) AS ts_day, CAST(month(ts) AS INTEGER) AS ts_month,
          CAST(year(ts) AS INTEGER) AS ts_year, CAST(hour(ts) AS INTEGER) AS ts_hour,
          CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(second(ts) AS INTEGER) AS ts_second FROM events""",
)
def _(spark, d):
    return dates.split_date(
        table(spark, d, "events").select("event_id", "ts"),
        "ts",
        ("day", "month", "year", "hour", "minute", "second"),
    )


@add("agg_group_size", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def _(spark, d):
    return aggregate.group_size(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "n")


@add(
    "agg_global_summary",
    f"""WITH {CUSTOMER_SYN}
        SELECT 'c_acctbal' AS "column", count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean,
               round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max FROM customer_syn
        UNION ALL
        SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 6), min(c_nationkey)::DOUBLE,
               max(c_nationkey)::DOUBLE FROM customer_syn""",
)
def _(spark, d):
    return aggregate.rounded(aggregate.summary(customer_syn(spark, d), ["c_acctbal", "c_nationkey"]))


@add(
    "agg_distinct",
    """SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS n_distinct FROM orders
       UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
)
def _(spark, d):
    return aggregate.unique_counts(
        table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"]
    )


@add(
    "agg_prevalence",
    """SELECT c_mktsegment, count(*) AS n, round(avg((o_orderstatus = 'F')::INTEGER), 6) AS share_finished,
          round(avg((o_orderpriority = '1-URGENT')::INTEGER), 6) AS share_urgent
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
       HAVING sum((o_orderstatus = 'F')::INTEGER) > 0 AND sum((o_orderpriority = '1-URGENT')::INTEGER) > 0""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = aggregate.prevalence(
        rows,
        ["c_mktsegment"],
        {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"},
    )
    return aggregate.rounded(out)


@add(
    "win_first_per_key",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
       FROM orders GROUP BY 1""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return clean.first_per_key(o, "o_custkey", "o_orderkey")
