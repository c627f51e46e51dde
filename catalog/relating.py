"""Crosstabs and association between columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    BALANCE_EDGES,
    BALANCE_LABELS,
    CUSTOMER_SYN,
    Family,
    bin_sql,
    customer_syn,
    table,
)
from twinlake.functions.generalize import bin_numeric
from twinlake.operators import association as assoc
from twinlake.operators import crosstab as ct
from twinlake.operators.aggregate import rounded

family = Family()
add = family.add

_BAND = bin_sql("c_acctbal", BALANCE_EDGES, BALANCE_LABELS)


def banded(df):
    return df.select("*", bin_numeric("c_acctbal", BALANCE_EDGES, BALANCE_LABELS).alias("band"))


SIDES = f"""WITH {CUSTOMER_SYN}, o AS (SELECT *, {_BAND} AS band FROM customer),
  s AS (SELECT *, {_BAND} AS band FROM customer_syn)"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SYNTHETIC"]


@add(
    "biv_crosstab",
    f"""{SIDES} SELECT band, c_mktsegment, count(*) AS n FROM s
        WHERE band IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    return ct.crosstab(banded(customer_syn(spark, d)), "band", ["c_mktsegment"])


@add(
    "biv_crosstab_wide",
    "SELECT o_orderstatus, " + ", ".join(
        f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    ) + " FROM orders GROUP BY 1",
)
def _(spark, d):
    return ct.crosstab(table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"], "wide")


@add(
    "biv_crosstab_multi",
    f"""{SIDES} SELECT c_nationkey, c_mktsegment, band, count(*) AS n FROM s
        WHERE band IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return ct.crosstab(banded(customer_syn(spark, d)), "c_nationkey", ["c_mktsegment", "band"])


_CELLS = """cells AS (SELECT band, c_mktsegment, CAST(sum(o) AS BIGINT) AS n_original, CAST(sum(s) AS BIGINT) AS n_synthetic
  FROM (SELECT band, c_mktsegment, 1 AS o, 0 AS s FROM o UNION ALL SELECT band, c_mktsegment, 0, 1 FROM s)
  WHERE band IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2)"""


@add(
    "biv_compare",
    f"""{SIDES}, {_CELLS} SELECT *, round(n_original / (sum(n_original) OVER ())::DOUBLE, 6) AS share_original,
        round(n_synthetic / (sum(n_synthetic) OVER ())::DOUBLE, 6) AS share_synthetic FROM cells""",
)
def _(spark, d):
    o, s = banded(table(spark, d, "customer")), banded(customer_syn(spark, d))
    return rounded(ct.compare_crosstab(o, s, "band", ["c_mktsegment"]))


@add(
    "biv_distance",
    f"""{SIDES}, {_CELLS}, t AS (SELECT sum(n_original) AS o, sum(n_synthetic) AS s FROM cells)
        SELECT round(0.5 * sum(abs(n_original / t.o::DOUBLE - n_synthetic / t.s::DOUBLE)), 6) AS distance,
               count(*) AS cells FROM cells, t""",
)
def _(spark, d):
    o, s = banded(table(spark, d, "customer")), banded(customer_syn(spark, d))
    return rounded(ct.crosstab_distance(ct.compare_crosstab(o, s, "band", ["c_mktsegment"])))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(src, cols):
    arms = [
        f"SELECT '{a}' AS x, '{b}' AS y, round(" + ("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + f", 6) AS value FROM {src}"
        + (" LIMIT 1" if a == b else "")
        for a in cols
        for b in cols
    ]
    return " UNION ALL ".join(f"({a})" for a in arms)


@add("assoc_pearson", _corr_sql("lineitem", NUMERIC))
def _(spark, d):
    return rounded(assoc.corr_matrix(table(spark, d, "lineitem").select(*NUMERIC), NUMERIC))


def lines_parts(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", *NUMERIC)
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


LINES = "lp AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _cells_sql(src, a, b):
    return (
        f"(SELECT n, sum(n) OVER (PARTITION BY va) AS r, sum(n) OVER (PARTITION BY vb) AS c, "
        f"sum(n) OVER () AS t FROM (SELECT {a} AS va, {b} AS vb, count(*) AS n FROM {src} GROUP BY 1, 2))"
    )


def _cramer_sql(src, a, b):
    return f"""SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN low > 0 THEN sqrt(greatest(0.0::DOUBLE,
        q - 1 - (ka - 1) * (kb - 1) / (t - 1)) / low) END, 6) AS value FROM (
      SELECT *, least(ka - (ka - 1) ** 2 / (t - 1), kb - (kb - 1) ** 2 / (t - 1)) - 1 AS low FROM (
        SELECT sum(n::DOUBLE * n / r / c) AS q, any_value(t)::DOUBLE AS t,
          (SELECT count(*) FROM (SELECT DISTINCT {a} FROM {src}))::DOUBLE AS ka,
          (SELECT count(*) FROM (SELECT DISTINCT {b} FROM {src}))::DOUBLE AS kb
        FROM {_cells_sql(src, a, b)}))"""


def _theil_sql(src, a, b):
    return f"""SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN h <= 1e-15 THEN 1.0 ELSE (h - hc) / h END, 6) AS value
      FROM (SELECT -sum(n / t::DOUBLE * ln(r / t::DOUBLE)) AS h, -sum(n / t::DOUBLE * ln(n / c::DOUBLE)) AS hc
            FROM {_cells_sql(src, a, b)})"""


def _eta_sql(src, a, b):
    return f"""SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN sst > 0 THEN sqrt(ssb / sst) ELSE 0 END, 6) AS value
      FROM (SELECT sum((m - g) ** 2) AS ssb, sum((w - g) ** 2) AS sst FROM (
        SELECT w, avg(w) OVER (PARTITION BY v) AS m, avg(w) OVER () AS g
        FROM (SELECT {a} AS v, coalesce({b}, 0)::DOUBLE AS w FROM {src})))"""


def _flip(sql):
    return f"(SELECT y AS x, x AS y, value FROM ({sql}))"


@add("assoc_cramers_v", f"WITH {LINES} {_cramer_sql('lp', 'l_returnflag', 'l_linestatus')} UNION ALL {_cramer_sql('lp', 'p_type', 'p_brand')}")
def _(spark, d):
    lp = lines_parts(spark, d)
    out = assoc.cramers_v(lp, "l_returnflag", "l_linestatus").unionByName(assoc.cramers_v(lp, "p_type", "p_brand"))
    return rounded(out)


@add(
    "assoc_theils_u",
    f"WITH {LINES} " + " UNION ALL ".join(
        _theil_sql("lp", a, b)
        for a, b in (("l_returnflag", "p_type"), ("p_type", "l_returnflag"), ("p_type", "p_brand"), ("p_brand", "p_type"))
    ),
)
def _(spark, d):
    lp = lines_parts(spark, d)
    return rounded(assoc.theils_u(lp, "l_returnflag", "p_type").unionByName(assoc.theils_u(lp, "p_type", "p_brand")))


@add(
    "assoc_correlation_ratio",
    f"WITH {LINES} " + " UNION ALL ".join(
        _eta_sql("lp", a, b) for a in ("p_type", "l_returnflag") for b in ("l_quantity", "l_extendedprice")
    ),
)
def _(spark, d):
    return rounded(
        assoc.correlation_ratio(lines_parts(spark, d), ["p_type", "l_returnflag"], ["l_quantity", "l_extendedprice"])
    )


_NOM, _NUM = ["c_mktsegment", "c_nationkey"], ["c_acctbal", "c_custkey"]


def _matrix_sql(src, directed):
    nums = f"(SELECT coalesce(c_acctbal, 0) AS c_acctbal, c_custkey FROM {src})"
    arms = [f"SELECT '{c}' AS x, '{c}' AS y, 1.0::DOUBLE AS value" for c in _NOM]
    if directed:
        arms += [_theil_sql(src, *_NOM), _theil_sql(src, *reversed(_NOM))]
    else:
        arms += [_cramer_sql(src, *_NOM), _flip(_cramer_sql(src, *_NOM))]
    for a in _NOM:
        for b in _NUM:
            arms += [_eta_sql(src, a, b), _flip(_eta_sql(src, a, b))]
    return " UNION ALL ".join(f"({a})" for a in arms) + " UNION ALL " + _corr_sql(nums, _NUM)


@add("assoc_matrix", f"WITH {CUSTOMER_SYN} {_matrix_sql('customer_syn', True)}")
def _(spark, d):
    return rounded(assoc.association_matrix(customer_syn(spark, d), _NOM, _NUM, "theil"))


@add(
    "assoc_difference",
    f"""WITH {CUSTOMER_SYN}, a AS ({_matrix_sql('customer', False)}), b AS ({_matrix_sql('customer_syn', False)})
        SELECT x, y, round(abs(a.value - b.value), 4) AS difference FROM a JOIN b USING (x, y)""",
)
def _(spark, d):
    out = assoc.association_difference(table(spark, d, "customer"), customer_syn(spark, d), _NOM, _NUM)
    out = rounded(out).select("x", "y", F.round(F.abs(F.col("original") - F.col("synthetic")), 4).alias("difference"))
    return out
