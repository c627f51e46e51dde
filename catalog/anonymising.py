"""Equivalence classes, suppression, pseudonyms and whole recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import BALANCE_EDGES, BALANCE_LABELS, SEED, Family, bin_sql, table, u_sql
from twinlake.functions import generalize as g
from twinlake.operators import anonymity, clean
from twinlake.operators.aggregate import rounded
from twinlake.operators.pseudonym import pseudonymize
from twinlake.plans.recipe import Recipe

family = Family()
add = family.add

QI = ["c_nationkey", "band"]


def banded(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        "c_nationkey",
        g.bin_numeric("c_acctbal", BALANCE_EDGES, BALANCE_LABELS).alias("band"),
        g.bin_numeric("c_acctbal", BALANCE_EDGES).alias("band_rank"),
        "c_mktsegment",
    )


BANDED = f"""banded AS (SELECT c_custkey, c_nationkey, {bin_sql('c_acctbal', BALANCE_EDGES, BALANCE_LABELS)} AS band,
  CAST({bin_sql('c_acctbal', BALANCE_EDGES)} AS INTEGER) AS band_rank, c_mktsegment FROM customer)"""
KEPT = f"""{BANDED}, kept AS (SELECT * FROM banded WHERE band IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY c_nationkey, band) > 8)"""


def kept(spark, d):
    return anonymity.suppress_small_groups(banded(spark, d), QI, 8)


def flagship(spark, d):
    """Customers by region and balance band: suppress small classes, report k, l and t per class."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = banded(spark, d).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    qi = ["n_regionkey", "band"]
    safe = anonymity.suppress_small_groups(rows, qi, 5)
    return rounded(anonymity.class_report(safe, qi, {"c_mktsegment": "categorical"}))


@add("anon_suppress_small_groups", f"WITH {KEPT} SELECT c_custkey, c_nationkey, band, c_mktsegment FROM kept")
def _(spark, d):
    return kept(spark, d).select("c_custkey", "c_nationkey", "band", "c_mktsegment")


@add(
    "anon_k_anonymity",
    f"""WITH {KEPT} SELECT min(n) AS k, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows
        FROM (SELECT count(*) AS n FROM kept GROUP BY c_nationkey, band)""",
)
def _(spark, d):
    return anonymity.k_anonymity(kept(spark, d), QI)


@add(
    "anon_l_diversity",
    f"""WITH {KEPT} SELECT min(least(a, b)) AS l FROM (
          SELECT count(DISTINCT c_mktsegment) + max((c_mktsegment IS NULL)::INTEGER) AS a,
                 count(DISTINCT c_custkey) AS b FROM kept GROUP BY c_nationkey, band)""",
)
def _(spark, d):
    return anonymity.l_diversity(kept(spark, d), QI, ["c_mktsegment", "c_custkey"])


def _categorical_t(src, qi, sa):
    keys = ", ".join(qi)
    return f"""SELECT {keys}, 0.5 * sum(abs(p - q)) AS t FROM (
      SELECT {', '.join('k.' + c for c in qi)}, coalesce(c.n, 0) / k.n::DOUBLE AS p, v.n / tot.n::DOUBLE AS q
      FROM (SELECT {keys}, count(*) AS n FROM {src} GROUP BY ALL) k
      CROSS JOIN (SELECT {sa} AS val, count(*) AS n FROM {src} GROUP BY ALL) v
      CROSS JOIN (SELECT count(*) AS n FROM {src}) tot
      LEFT JOIN (SELECT {keys}, {sa} AS val, count(*) AS n FROM {src} GROUP BY ALL) c
        ON {' AND '.join(f'c.{x} = k.{x}' for x in qi)} AND c.val IS NOT DISTINCT FROM v.val)
    GROUP BY ALL"""


def _ordered_t(src, qi, sa):
    keys = ", ".join(qi)
    return f"""SELECT {keys}, sum(abs(d)) / greatest(max(m) - 1, 1) AS t FROM (
      SELECT {keys}, m, sum(p - q) OVER (PARTITION BY {keys} ORDER BY val) AS d FROM (
        SELECT {', '.join('k.' + c for c in qi)}, v.val, v.m, coalesce(c.n, 0) / k.n::DOUBLE AS p,
               v.n / tot.n::DOUBLE AS q
        FROM (SELECT {keys}, count(*) AS n FROM {src} GROUP BY ALL) k
        CROSS JOIN (SELECT val, n, count(*) OVER () AS m FROM
                     (SELECT {sa} AS val, count(*) AS n FROM {src} GROUP BY ALL)) v
        CROSS JOIN (SELECT count(*) AS n FROM {src}) tot
        LEFT JOIN (SELECT {keys}, {sa} AS val, count(*) AS n FROM {src} GROUP BY ALL) c
          ON {' AND '.join(f'c.{x} = k.{x}' for x in qi)} AND c.val = v.val))
    GROUP BY ALL"""


@add(
    "anon_t_closeness",
    f"""WITH {BANDED}, seg AS ({_categorical_t('banded', ['c_nationkey', 'band'], 'c_mktsegment')}),
        rk AS ({_ordered_t('banded', ['c_nationkey'], 'band_rank')})
        SELECT 'c_mktsegment' AS attribute, round(max(t), 6) AS t FROM seg
        UNION ALL SELECT 'band_rank', round(max(t), 6) FROM rk""",
)
def _(spark, d):
    df = banded(spark, d)
    seg = anonymity.t_closeness(df, QI, {"c_mktsegment": "categorical"})
    rank = anonymity.t_closeness(df, ["c_nationkey"], {"band_rank": "ordered"})
    return rounded(seg.unionByName(rank))


@add(
    "anon_t_closeness_fine",
    f"""SELECT c_nationkey, round(t, 6) AS t FROM ({_ordered_t('customer', ['c_nationkey'], 'c_acctbal')})""",
)
def _(spark, d):
    df = table(spark, d, "customer").select("c_nationkey", "c_acctbal")
    return rounded(anonymity.class_t(df, ["c_nationkey"], "c_acctbal", "ordered"))


@add(
    "anon_class_report",
    f"""WITH {KEPT}, t AS ({_categorical_t('kept', ['c_nationkey', 'band'], 'c_mktsegment')})
        SELECT c_nationkey, band, count(*) AS size, count(DISTINCT c_mktsegment) AS "l_c_mktsegment",
               round(any_value(t.t), 6) AS "t_c_mktsegment"
        FROM kept JOIN t USING (c_nationkey, band) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(anonymity.class_report(kept(spark, d), QI, {"c_mktsegment": "categorical"}))


def orders_by_nation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


ORDERS = """ord AS (SELECT o_orderkey, o_custkey, o_orderdate, c_name, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _pseudonyms(src, col):
    return f"""SELECT v, CAST(5 * (row_number() OVER (ORDER BY md5('{SEED}:pseudonym:' || txt)) - 1) + 1
        + floor(4 * {u_sql('pseudonym-gap', 'txt')}) AS BIGINT) AS p
      FROM (SELECT DISTINCT {col} AS v, coalesce(CAST({col} AS VARCHAR), '<null>') AS txt FROM {src})"""


@add(
    "anon_pseudonymize",
    f"""WITH src AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey FROM orders),
        m AS ({_pseudonyms('src', 'o_custkey')})
        SELECT o_orderkey, p AS o_custkey FROM src JOIN m ON o_custkey IS NOT DISTINCT FROM v""",
)
def _(spark, d):
    member = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey")
    return pseudonymize(table(spark, d, "orders").select("o_orderkey", member), "o_custkey", SEED)


@add(
    "anon_min_distinct_per_group",
    f"""WITH {ORDERS}, f AS (SELECT o_custkey, arg_min(c_nationkey, o_orderkey) AS g FROM ord GROUP BY 1)
        SELECT o_orderkey, c_nationkey FROM ord
        WHERE c_nationkey NOT IN (SELECT g FROM f GROUP BY 1 HAVING count(*) < 60)""",
)
def _(spark, d):
    out = anonymity.suppress_min_distinct(
        orders_by_nation(spark, d), "c_nationkey", "o_custkey", "o_orderkey", 60
    )
    return out.select("o_orderkey", "c_nationkey")


ORDER_RECIPE = Recipe(
    steps=[
        {"op": "drop", "cols": ["c_name"]},
        {"op": "date", "cols": ["o_orderdate"], "level": "month"},
        {"op": "pseudonymize", "col": "o_custkey"},
        {"op": "suppress_small_groups", "qi": ["c_nationkey", "o_orderdate"], "min_size": 40},
        {"op": "suppress_min_distinct", "group": "c_nationkey", "member": "o_custkey",
         "order": "o_orderkey", "n": 55},
    ],
    qi=["c_nationkey", "o_orderdate"],
    member="o_custkey",
)

_RECIPE = f"""{ORDERS}, m AS ({_pseudonyms('ord', 'o_custkey')}),
  a AS (SELECT o_orderkey, p AS o_custkey, strftime(o_orderdate, '%m') AS o_orderdate, c_nationkey
        FROM ord JOIN m ON o_custkey = v),
  b AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY c_nationkey, o_orderdate) > 40),
  f AS (SELECT o_custkey, arg_min(c_nationkey, o_orderkey) AS g FROM b GROUP BY 1),
  c AS (SELECT * FROM b WHERE c_nationkey NOT IN (SELECT g FROM f GROUP BY 1 HAVING count(*) < 55))"""


@add("anon_recipe", f"WITH {_RECIPE} SELECT * FROM c")
def _(spark, d):
    return ORDER_RECIPE.apply(orders_by_nation(spark, d), SEED)


@add(
    "anon_recipe_measures",
    f"""WITH {_RECIPE}, mem AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
        SELECT 'rows' AS scope, 'k' AS measure, CAST(NULL AS VARCHAR) AS attribute, CAST(min(n) AS DOUBLE) AS value
        FROM (SELECT count(*) AS n FROM c GROUP BY c_nationkey, o_orderdate)
        UNION ALL SELECT 'members', 'k', NULL, CAST(min(n) AS DOUBLE)
        FROM (SELECT count(*) AS n FROM mem GROUP BY c_nationkey, o_orderdate)""",
)
def _(spark, d):
    out = ORDER_RECIPE.apply(orders_by_nation(spark, d), SEED)
    return ORDER_RECIPE.measure(out, order="o_orderkey")
