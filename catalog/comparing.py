"""Original against synthetic: column fidelity and leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import CUSTOMER_SYN, LINEITEM_SYN, SEED, Family, bin_sql, customer_syn, lineitem_syn, table
from twinlake.operators import fidelity, leakage
from twinlake.operators.aggregate import rounded
from twinlake.plans.recipe import Recipe
from twinlake.plans.validate import Validation, measures, validate
from twinlake.sources.roles import Roles
from twinlake.sources.scratch import materialize

family = Family()
add = family.add

RANGED = ["c_acctbal", "c_nationkey"]
PAIR = f"WITH {CUSTOMER_SYN}, {LINEITEM_SYN}"


def pair(spark, d):
    return table(spark, d, "customer"), customer_syn(spark, d)


def shipped(spark, d):
    return (
        table(spark, d, "lineitem").select("l_shipdate"),
        lineitem_syn(spark, d).select("l_shipdate"),
    )


def _stats(col, src, expr=None):
    e = expr or col
    return (
        f"(SELECT avg({e}) AS mean, median({e}) AS median, stddev_samp({e}) AS std, min({e})::DOUBLE AS lo, "
        f"max({e})::DOUBLE AS hi FROM {src})"
    )


def _similarity(col, o, s, expr=None):
    arms = [
        f"SELECT '{col}' AS \"column\", '{st}_similarity' AS metric, round(CASE WHEN a.hi > a.lo THEN "
        f"greatest(0.0::DOUBLE, 1 - abs(a.{st} - b.{st}) / (a.hi - a.lo)) END, 6) AS value "
        f"FROM {_stats(col, o, expr)} a, {_stats(col, s, expr)} b"
        for st in ("mean", "median", "std")
    ]
    return " UNION ALL ".join(arms)


def _coverage(col, o, s, expr=None):
    return (
        f"SELECT '{col}' AS \"column\", 'range_coverage' AS metric, round(CASE WHEN a.hi > a.lo THEN "
        "greatest(0.0::DOUBLE, 1 - (greatest((b.lo - a.lo) / (a.hi - a.lo), 0) "
        "+ greatest((a.hi - b.hi) / (a.hi - a.lo), 0))) END, 6) AS value "
        f"FROM {_stats(col, o, expr)} a, {_stats(col, s, expr)} b"
    )


def _adherence(col, o, s):
    return (
        f"SELECT '{col}' AS \"column\", 'boundary_adherence' AS metric, round(avg(({col} BETWEEN "
        f"(SELECT min({col}) FROM {o}) AND (SELECT max({col}) FROM {o}))::INTEGER), 6) AS value FROM {s}"
    )


def _categories(col, o, s):
    return (
        f"SELECT '{col}' AS \"column\", 'category_coverage' AS metric, round(avg((v IN (SELECT {col} FROM {s} "
        f"WHERE {col} IS NOT NULL))::INTEGER), 6) AS value "
        f"FROM (SELECT DISTINCT {col} AS v FROM {o} WHERE {col} IS NOT NULL)"
    )


def _tv(col, o, s):
    return (
        f"SELECT '{col}' AS \"column\", 'frequency_similarity' AS metric, round(1 - 0.5 * sum(abs("
        "coalesce(a.p, 0) - coalesce(b.p, 0))), 6) AS value "
        f"FROM (SELECT {col} AS v, count(*) / (SELECT count(*) FROM {o})::DOUBLE AS p FROM {o} GROUP BY 1) a "
        f"FULL JOIN (SELECT {col} AS v, count(*) / (SELECT count(*) FROM {s})::DOUBLE AS p FROM {s} GROUP BY 1) b "
        "ON a.v IS NOT DISTINCT FROM b.v"
    )


def _missing(col, o, s):
    return (
        f"SELECT '{col}' AS \"column\", 'missing_similarity' AS metric, round(1 - abs("
        f"(SELECT avg(({col} IS NULL)::INTEGER) FROM {o}) - (SELECT avg(({col} IS NULL)::INTEGER) FROM {s})), 6) "
        "AS value"
    )


def _all(*arms):
    return f"{PAIR} " + " UNION ALL ".join(arms)


@add(
    "fid_statistic_similarity",
    _all(
        *[_similarity(c, "customer", "customer_syn") for c in RANGED],
        _similarity("l_shipdate", "lineitem", "lineitem_syn", "epoch_us(l_shipdate)::DOUBLE"),
    ),
)
def _(spark, d):
    out = fidelity.statistic_similarity(*pair(spark, d), RANGED)
    return rounded(out.unionByName(fidelity.statistic_similarity(*shipped(spark, d), ["l_shipdate"])))


@add(
    "fid_range_coverage",
    _all(
        *[_coverage(c, "customer", "customer_syn") for c in RANGED],
        _coverage("l_shipdate", "lineitem", "lineitem_syn", "epoch_us(l_shipdate)::DOUBLE"),
    ),
)
def _(spark, d):
    out = fidelity.range_coverage(*pair(spark, d), RANGED)
    return rounded(out.unionByName(fidelity.range_coverage(*shipped(spark, d), ["l_shipdate"])))


@add(
    "fid_boundary_adherence",
    _all(
        *[_adherence(c, "customer", "customer_syn") for c in RANGED],
        _adherence("l_shipdate", "lineitem", "lineitem_syn"),
    ),
)
def _(spark, d):
    out = fidelity.boundary_adherence(*pair(spark, d), RANGED)
    return rounded(out.unionByName(fidelity.boundary_adherence(*shipped(spark, d), ["l_shipdate"])))


_NAMED = ["c_mktsegment", "c_nationkey", "c_name"]


@add("fid_category_coverage", _all(*[_categories(c, "customer", "customer_syn") for c in _NAMED]))
def _(spark, d):
    return rounded(fidelity.category_coverage(*pair(spark, d), _NAMED))


@add("fid_tv_complement", _all(*[_tv(c, "customer", "customer_syn") for c in _NAMED]))
def _(spark, d):
    return rounded(fidelity.tv_complement(*pair(spark, d), _NAMED))


@add(
    "fid_missing_similarity",
    _all(*[_missing(c, "customer", "customer_syn") for c in ("c_acctbal", "c_mktsegment", "c_nationkey")]),
)
def _(spark, d):
    return rounded(fidelity.missing_similarity(*pair(spark, d), ["c_acctbal", "c_mktsegment", "c_nationkey"]))


_CATS = ["c_mktsegment", "c_nationkey"]
_REPORT = [
    _similarity("c_acctbal", "customer", "customer_syn"),
    _coverage("c_acctbal", "customer", "customer_syn"),
    _adherence("c_acctbal", "customer", "customer_syn"),
    _tv("c_acctbal", "customer", "customer_syn"),
    *[_categories(c, "customer", "customer_syn") for c in _CATS],
    *[_missing(c, "customer", "customer_syn") for c in ["c_acctbal", *_CATS]],
]


@add(
    "fid_report",
    f"{PAIR} SELECT 'customer' AS dataset, 'noise' AS method, * FROM (" + " UNION ALL ".join(_REPORT) + ")",
)
def _(spark, d):
    roles = Roles(continuous=["c_acctbal"], categorical=_CATS)
    return rounded(fidelity.structural_report(*pair(spark, d), roles, "customer", "noise"))


@add("fid_mixture_loglik")
def _(spark, d):
    o, s = pair(spark, d)
    return rounded(fidelity.mixture_loglik(o, s, RANGED), 3)


def _exists(cols):
    return " AND ".join(f"o.{c} IS NOT DISTINCT FROM s.{c}" for c in cols)


def _flag(cols):
    return f"EXISTS (SELECT 1 FROM customer o WHERE {_exists(cols)}) AS \"{'+'.join(cols)}_in_original\""


@add("leak_pii_single", f"{PAIR} SELECT c_custkey, c_name, {_flag(['c_name'])} FROM customer_syn s")
def _(spark, d):
    o, s = pair(spark, d)
    return leakage.pii_leak(o, s.select("c_custkey", "c_name"), "c_name")


@add(
    "leak_pii_pair",
    f"{PAIR} SELECT c_custkey, c_name, c_nationkey, {_flag(['c_name', 'c_nationkey'])} FROM customer_syn s",
)
def _(spark, d):
    o, s = pair(spark, d)
    return leakage.pii_leak(o, s.select("c_custkey", "c_name", "c_nationkey"), ["c_name", "c_nationkey"])


_COMBOS = [["c_nationkey", "c_mktsegment"], ["c_name", "c_nationkey", "c_mktsegment"]]


@add(
    "leak_quasi_id",
    f"{PAIR} SELECT c_custkey, {', '.join(_flag(c) for c in _COMBOS)} FROM customer_syn s",
)
def _(spark, d):
    o, s = pair(spark, d)
    return leakage.quasi_leak(o, s.drop("c_acctbal"), _COMBOS).drop("c_name", "c_nationkey", "c_mktsegment")


def _leak_arm(cols):
    return (
        f"SELECT '{'+'.join(cols)}' AS \"check\", count(*) AS total, CAST(sum(hit::INTEGER) AS BIGINT) AS matched, "
        f"round(avg(hit::INTEGER), 6) AS share FROM (SELECT EXISTS (SELECT 1 FROM customer o WHERE {_exists(cols)}) "
        "AS hit FROM customer_syn s)"
    )


_CHECKS = [["c_name"], ["c_name", "c_nationkey"], *_COMBOS]


@add("leak_report", _all(*[_leak_arm(c) for c in _CHECKS]))
def _(spark, d):
    return rounded(leakage.leak_report(*pair(spark, d), _CHECKS))


def types_apart(spark, d):
    """Every second customer's numbers as doubles, and every customer's as decimals and text."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    tiny, big, huge = F.concat("k", F.lit("e-4")), F.concat(25_000_000 + F.col("k"), F.lit(".5")), 9_100_000_000_000_000 + 2 * F.col("k")
    o = c.where("k % 2 = 0").select(tiny.cast("double").alias("tiny"), big.cast("double").alias("big"), huge.cast("double").alias("huge"))
    return o, c.select(tiny.cast("decimal(20,6)").alias("tiny"), big.alias("big"), huge.alias("huge"))


_APART = [["tiny"], ["big"], ["huge"], ["tiny", "big", "huge"]]


@add(
    "leak_values_across_types",
    _all(
        *[
            f"SELECT '{'+'.join(c)}' AS \"check\", count(*) AS total, count(*) FILTER (c_custkey % 2 = 0) AS matched, "
            "round(count(*) FILTER (c_custkey % 2 = 0) / count(*), 6) AS share FROM customer"
            for c in _APART
        ]
    ),
)
def _(spark, d):
    return rounded(leakage.leak_report(*types_apart(spark, d), _APART))


@add(
    "fid_values_across_types",
    _all(
        *[
            f"SELECT '{c}' AS \"column\", 'category_coverage' AS metric, 1.0::DOUBLE AS value "
            f"UNION ALL SELECT '{c}', 'frequency_similarity', round(count(*) FILTER (c_custkey % 2 = 0) / count(*), 6) FROM customer"
            for c in ("tiny", "big", "huge")
        ]
    ),
)
def _(spark, d):
    o, s = types_apart(spark, d)
    cols = ["tiny", "big", "huge"]
    return rounded(fidelity.category_coverage(o, s, cols).unionByName(fidelity.tv_complement(o, s, cols)))


_CELL_SQL = f"""SELECT 'c_mktsegment x c_nationkey' AS item, 'tv_distance' AS metric, round(0.5 * sum(abs(
    n_o / (SELECT count(*) FROM customer)::DOUBLE - n_s / (SELECT count(*) FROM known)::DOUBLE)), 6) AS value FROM (
      SELECT sum(o) AS n_o, sum(s) AS n_s FROM (SELECT c_mktsegment, c_nationkey, 1 AS o, 0 AS s FROM customer
        UNION ALL SELECT c_mktsegment, c_nationkey, 0, 1 FROM known) GROUP BY c_mktsegment, c_nationkey)"""


@add(
    "plan_validate",
    f"""{PAIR}, known AS (SELECT * FROM customer_syn WHERE c_mktsegment IS NOT NULL)
        SELECT 'structure' AS phase, "column" AS item, metric, value FROM ({' UNION ALL '.join(_REPORT)})
        UNION ALL SELECT 'bivariate', * FROM ({_CELL_SQL})
        UNION ALL SELECT 'privacy', "check", 'share', share FROM ({' UNION ALL '.join(_leak_arm(c) for c in _CHECKS)})""",
)
def _(spark, d):
    spec = Validation(
        roles=Roles(continuous=["c_acctbal"], categorical=_CATS),
        crosstabs=[("c_mktsegment", ["c_nationkey"])],
        pii=_CHECKS[:2],
        quasi=_COMBOS,
    )
    phases = ("structure", "bivariate", "privacy")
    return rounded(measures(validate(*pair(spark, d), spec, "customer", "noise", ["c_custkey"], phases)))


@add("plan_validate_all")
def _(spark, d):
    """All five phases; the two that fit models have no SQL."""
    spec = Validation(
        roles=Roles(continuous=["c_acctbal"], categorical=_CATS),
        crosstabs=[("c_mktsegment", ["c_nationkey"])],
        features=["c_acctbal", "c_nationkey"],
        targets=["c_mktsegment"],
        models=("tree",),
        pii=_CHECKS[:2],
        quasi=_COMBOS,
    )
    return rounded(measures(validate(*pair(spark, d), spec, "customer", "noise", ["c_custkey"])))


_PRICE_EDGES, _PRICE_LABELS = [0, 50_000, 150_000, 300_000, 1_000_000], ["low", "mid", "high", "top"]


def safe_orders(spark, d):
    """Orders and what a recipe makes of them; the coarser price has a column of its own on both sides."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    recipe = Recipe(
        steps=[
            {"op": "pseudonymize", "col": "o_custkey", "method": "hash"},
            {"op": "bin", "col": "o_totalprice", "edges": _PRICE_EDGES, "labels": _PRICE_LABELS},
            {"op": "date", "cols": ["o_orderdate"], "level": "year"},
            {"op": "suppress_small_groups", "qi": ["o_totalprice", "o_orderdate"], "min_size": 15},
        ],
        qi=["o_totalprice", "o_orderdate"],
    )
    safe = materialize(recipe.apply(orders, SEED))
    return orders.withColumn("price_band", F.lit(None).cast("string")), safe.withColumnRenamed("o_totalprice", "price_band")


@add(
    "plan_anonymise",
    f"""WITH safe AS (SELECT band, year, count(*) AS n FROM (
          SELECT {bin_sql('o_totalprice', _PRICE_EDGES, _PRICE_LABELS)} AS band, year(o_orderdate) AS year FROM orders)
          GROUP BY 1, 2 HAVING count(*) > 15)
        SELECT 'anonymity' AS phase, 'class' AS item, 'rows' AS metric, sum(n)::DOUBLE AS value FROM safe
        UNION ALL SELECT 'anonymity', 'class', 'classes', count(*)::DOUBLE FROM safe
        UNION ALL SELECT 'anonymity', 'class', 'k', min(n)::DOUBLE FROM safe
        UNION ALL SELECT 'privacy', 'o_custkey', 'share', 0.0::DOUBLE
        UNION ALL SELECT 'privacy', 'o_orderkey+o_orderstatus', 'share', 1.0::DOUBLE""",
)
def _(spark, d):
    """What a recipe leaves: rows, classes, the smallest class, and which values still meet the original's."""
    orders, safe = safe_orders(spark, d)
    classes = safe.groupBy("price_band", "o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    counted = {"rows": F.sum("n"), "classes": F.count(F.lit(1)), "k": F.min("n")}
    rows = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in counted.items()]
    kept = classes.agg(F.array(*rows).alias("__m")).select(F.lit("anonymity").alias("phase"), F.lit("class").alias("item"), F.inline("__m"))
    spec = Validation(roles=Roles(), pii=[["o_custkey"]], quasi=[["o_orderkey", "o_orderstatus"]])
    return rounded(kept.unionByName(measures(validate(orders, safe, spec, "orders", "recipe", ["o_orderkey"], ("privacy",)))))


@add("plan_anonymise_use")
def _(spark, d):
    """How well the order status is told from the exact price before, and from its band after the recipe."""
    orders, safe = safe_orders(spark, d)
    spec = Validation(
        roles=Roles(categorical=["o_orderstatus", "o_orderpriority", "price_band"]),
        features=["o_totalprice", "o_orderpriority"],
        features_other=["price_band", "o_orderpriority"],
        targets=["o_orderstatus"],
        models=("tree",),
    )
    safe = safe.withColumn("o_totalprice", F.lit(None).cast("double"))
    return rounded(measures(validate(orders, safe, spec, "orders", "recipe", ["o_orderkey"], ("applicability",), share_codes=False)))
