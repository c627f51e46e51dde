"""Bayesian network, private aggregates, constraints and statistical synthesis."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import CUSTOMER_SYN, SEED, Family, customer_syn, table, u_sql
from twinlake.functions.rand import uniform
from twinlake.operators import constraints as con
from twinlake.operators import dp
from twinlake.operators import synthesize as syn
from twinlake.operators.aggregate import rounded
from twinlake.operators.bayesnet import BayesNet, compare_correlation, compare_prevalence
from twinlake.operators.budget import Budget, BudgetExceeded
from twinlake.sources.scratch import shared_dir

family = Family()
add = family.add

EDGES = [("event_type", "high"), ("weekday", "high")]


def event_states(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        "event_type",
        F.date_format("ts", "EEEE").alias("weekday"),
        (F.col("value") > 100).cast("int").alias("high"),
    )


EVENTS = "ev AS (SELECT event_id, event_type, strftime(ts, '%A') AS weekday, (value > 100)::INTEGER AS high FROM events)"


def _cpd(node, given, keys):
    part = f"PARTITION BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""SELECT '{node}' AS node, {given} AS given, CAST({node} AS VARCHAR) AS value, n,
        round(n / (sum(n) OVER ({part}))::DOUBLE, 6) AS p,
        round((sum(n) OVER ({part} ORDER BY {node})) / (sum(n) OVER ({part}))::DOUBLE, 6) AS cum
      FROM (SELECT {cols}{node}, count(*) AS n FROM ev GROUP BY ALL)"""


@add(
    "bn_cpd",
    f"""WITH {EVENTS} {_cpd('event_type', "''", '')} UNION ALL {_cpd('weekday', "''", '')} UNION ALL
        {_cpd('high', "'event_type=' || event_type || ',weekday=' || weekday", 'event_type, weekday')}""",
)
def _(spark, d):
    return rounded(BayesNet(EDGES).fit(event_states(spark, d)).cpd_table())


def _draw(node, key, stream, src, keys=(), ref="e"):
    """SQL for one weighted draw: cells with position runs, then the run that covers the position."""
    cols = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cells = (
        f"SELECT *, sum(n) OVER ({part}ORDER BY {node} NULLS FIRST) AS hi, sum(n) OVER ({part}) AS total "
        f"FROM (SELECT {cols}{node}, count(*) AS n FROM {src} GROUP BY ALL)"
    )
    on = "".join(f"c.{k} IS NOT DISTINCT FROM {ref}.{k} AND " for k in keys)
    pos = f"floor({u_sql(stream, key)} * c.total)"
    return f"({cells}) c ON {on}{pos} < c.hi AND {pos} >= c.hi - c.n"


_SIM = f"""{EVENTS}, s1 AS (SELECT e.event_id, c.event_type FROM events e JOIN {_draw('event_type', 'event_id', 'event_type', 'ev')}),
  s2 AS (SELECT e.*, c.weekday FROM s1 e JOIN {_draw('weekday', 'event_id', 'weekday', 'ev')}),
  s3 AS (SELECT e.*, c.high FROM s2 e JOIN {_draw('high', 'event_id', 'high', 'ev', ['event_type', 'weekday'])})"""


@add("bn_simulate", f"WITH {_SIM} SELECT * FROM s3")
def _(spark, d):
    events = event_states(spark, d)
    return BayesNet(EDGES).fit(events).simulate(events.select("event_id"), SEED, "event_id")


@add(
    "bn_compare_prevalence",
    f"""WITH {_SIM}, a AS (SELECT weekday, count(*) AS n_original, round(avg(high), 6) AS share_high_original
            FROM ev GROUP BY 1),
          b AS (SELECT weekday, count(*) AS n_simulated, round(avg(high), 6) AS share_high_simulated FROM s3 GROUP BY 1)
        SELECT * FROM a FULL JOIN b USING (weekday)""",
)
def _(spark, d):
    events = event_states(spark, d)
    made = BayesNet(EDGES).fit(events).simulate(events.select("event_id"), SEED, "event_id")
    return rounded(compare_prevalence(events, made, ["weekday"], {"high": F.col("high") == 1}))


_CODED = ["high", "type_code", "day_code"]


def _coded(src):
    return f"(SELECT high, length(event_type) AS type_code, length(weekday) AS day_code FROM {src})"


@add(
    "bn_compare_correlation",
    f"WITH {_SIM} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, "
        + ", ".join(
            f"(SELECT {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6)'} FROM {_coded(src)} LIMIT 1) AS {name}"
            for src, name in (("ev", "original"), ("s3", "simulated"))
        )
        for a in _CODED
        for b in _CODED
    ),
)
def _(spark, d):
    def coded(df):
        return df.select("high", F.length("event_type").alias("type_code"), F.length("weekday").alias("day_code"))

    events = event_states(spark, d)
    made = BayesNet(EDGES).fit(events).simulate(events.select("event_id"), SEED, "event_id")
    return rounded(compare_correlation(coded(events), coded(made), _CODED))


def _lap(stream, key, scale):
    x = f"(greatest(1/4503599627370496.0::DOUBLE, least({u_sql(stream, key)}, 1 - 1/4503599627370496.0::DOUBLE)) - 0.5::DOUBLE)"
    return f"(-({scale})::DOUBLE * sign({x}) * ln(1 - 2 * abs({x})))"


@add(
    "dp_count",
    f"""SELECT c_mktsegment, CAST(round(count(*) + {_lap('dp_count', 'c_mktsegment', '1.0')}) AS BIGINT) AS dp_count
        FROM customer GROUP BY 1""",
)
def _(spark, d):
    return dp.dp_count(table(spark, d, "customer"), 1.0, SEED, by=["c_mktsegment"])


_GROUP_KEY = "concat_ws('-', c_nationkey, c_mktsegment)"


@add(
    "dp_group_counts",
    f"""SELECT c_nationkey, c_mktsegment, round(noisy)::BIGINT AS dp_count FROM (
          SELECT c_nationkey, c_mktsegment, count(*) + {_lap('dp_group_counts', _GROUP_KEY, '1.0')} AS noisy
          FROM customer GROUP BY 1, 2) WHERE noisy >= 1 + ln(1 / (2 * 1e-5::DOUBLE))""",
)
def _(spark, d):
    return dp.dp_group_counts(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 1.0, 1e-5, SEED)


_MEAN = f"""SELECT round(greatest(0.0::DOUBLE, least(10000.0::DOUBLE, 5000 +
    (sum(greatest(0, least(10000, c_acctbal)) - 5000) + {_lap('dp_mean/sum', "'c_acctbal'", '10000')})
    / greatest(1, count(c_acctbal) + {_lap('dp_mean/count', "'c_acctbal'", '2')}))), 6)"""


@add("dp_mean", f"{_MEAN} AS dp_mean FROM customer")
def _(spark, d):
    return rounded(dp.dp_mean(table(spark, d, "customer"), "c_acctbal", 0, 10000, 1.0, SEED))


def _quantile(q):
    u = f"greatest(1/4503599627370496.0::DOUBLE, least({u_sql(f'dp_quantile/c_acctbal/{q}', 'v')}, 1 - 1/4503599627370496.0::DOUBLE))"
    return f"""(SELECT arg_max(v, -greatest(under - t, t - (upto - 1), 0) * 0.5::DOUBLE - ln(-ln({u}))) FROM (
        SELECT v, upto, upto - n AS under, {q}::DOUBLE * (sum(n) OVER () - 1) AS t FROM (
          SELECT g.v, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (ORDER BY g.v) AS upto
          FROM (SELECT unnest(range(0, 10001)) AS v) g LEFT JOIN
            (SELECT CAST(floor(greatest(0, least(10000, c_acctbal))) AS BIGINT) AS v, count(*) AS n FROM customer
             GROUP BY 1) h ON g.v = h.v)))"""


@add(
    "dp_min_max",
    f"SELECT 'min' AS measure, {_quantile(0.0)} AS private UNION ALL SELECT 'max', {_quantile(1.0)}",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_acctbal")
    low = dp.dp_min(c, "c_acctbal", 0, 10000, 1.0, SEED).select(F.lit("min").alias("measure"), F.col("dp_min").alias("private"))
    high = dp.dp_max(c, "c_acctbal", 0, 10000, 1.0, SEED).select(F.lit("max").alias("measure"), F.col("dp_max").alias("private"))
    return low.unionByName(high)


@add(
    "dp_compare",
    f"""SELECT 'count' AS measure, count(c_acctbal)::DOUBLE AS exact,
               round(count(c_acctbal) + {_lap('dp_count', "'all'", '1.0')})::DOUBLE AS private FROM customer
        UNION ALL SELECT 'mean', round(avg(c_acctbal), 6), ({_MEAN} FROM customer) FROM customer
        UNION ALL SELECT 'min', min(c_acctbal), {_quantile(0.0)}::DOUBLE FROM customer
        UNION ALL SELECT 'max', max(c_acctbal), {_quantile(1.0)}::DOUBLE FROM customer""",
)
def _(spark, d):
    return rounded(dp.dp_compare(table(spark, d, "customer").select("c_acctbal"), "c_acctbal", 0, 10000, 1.0, SEED))


# Three releases of four values at epsilon 1 each from a total of 10: the third would spend 12 and is refused.
@add(
    "dp_budget",
    f"""WITH first_release AS (
          SELECT 'count' AS measure, 1 AS k, count(c_acctbal)::DOUBLE AS exact,
            round(count(c_acctbal) + {_lap('dp_count', "'all'", '1.0')})::DOUBLE AS private FROM customer
          UNION ALL SELECT 'mean', 2, round(avg(c_acctbal), 6), ({_MEAN} FROM customer) FROM customer
          UNION ALL SELECT 'min', 3, min(c_acctbal), {_quantile(0.0)}::DOUBLE FROM customer
          UNION ALL SELECT 'max', 4, max(c_acctbal), {_quantile(1.0)}::DOUBLE FROM customer)
        SELECT 'customers' AS release, measure, exact, private, 1.0::DOUBLE AS epsilon, k::DOUBLE AS spent FROM first_release
        UNION ALL SELECT 'again', measure, exact, private, 1.0::DOUBLE, (k + 4)::DOUBLE FROM first_release
        UNION ALL SELECT 'refused', NULL, NULL, NULL, NULL, 8.0::DOUBLE""",
)
def _(spark, d):
    budget = Budget(spark, f"{shared_dir(spark)}/budget-{uuid.uuid4().hex}", epsilon=10.0)
    rows = table(spark, d, "customer").select("c_acctbal")
    parts = []
    for release in ("customers", "again", "third"):
        try:
            part = rounded(dp.dp_compare(rows, "c_acctbal", 0, 10000, 1.0, SEED, budget, release))
            parts.append(part.select(F.lit(release).alias("release"), *part.columns))
        except BudgetExceeded:
            spent = budget.ledger().agg(F.max("spent").alias("spent"))
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema.fields[1:-1]]
            parts.append(spent.select(F.lit("refused").alias("release"), *empty, "spent"))
    return reduce(DataFrame.unionByName, parts)


@add(
    "dp_bound_contributions",
    f"""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id
        ORDER BY md5('{SEED}:contribution:' || event_id), event_id) <= 5""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    return dp.bound_contributions(events, "user_id", 5, SEED, ["event_id"])


def outcomes(spark, d):
    def u(stream):
        return uniform(SEED, stream, "o_orderkey")

    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "Died").when(F.col("o_orderstatus") == "O", "Recovered").alias("status"),
        F.when(u("rec") < 0.4, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("recovered"),
        F.when(u("die") < 0.4, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("died"),
    )


OUTCOMES = f"""outcomes AS (SELECT o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'Died' WHEN 'O' THEN 'Recovered' END AS status,
    CASE WHEN {u_sql('rec', 'o_orderkey')} < 0.4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS recovered,
    CASE WHEN {u_sql('die', 'o_orderkey')} < 0.4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS died FROM orders)"""
_OUTCOME_OK = """((status IS NOT DISTINCT FROM 'Died' AND recovered IS NULL)
    OR (status IS DISTINCT FROM 'Died' AND died IS NULL))"""


def outcome_rule():
    return con.outcome_constraint("status", "Died", "died", "recovered")


@add("con_row_predicate", f"WITH {OUTCOMES} SELECT * FROM outcomes WHERE {_OUTCOME_OK}")
def _(spark, d):
    return con.keep_valid(outcomes(spark, d), [outcome_rule()])


_LK = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
_LKS = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT))"


def shots(spark, d):
    key = [*_LK[:4], F.col("l_quantity").cast("long")]

    def u(stream):
        return uniform(SEED, stream, *key)

    given = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").select(
        *_LK,
        F.when(u("flag") >= 0.05, given).alias("given"),
        F.when(given & (u("product") < 0.9), F.col("l_linestatus")).alias("product"),
        F.when(given | (u("day") < 0.1), F.unix_date(F.to_date("l_shipdate"))).alias("day"),
        F.when(given, F.unix_date(F.to_date("l_shipdate")) + F.floor(u("span") * 100).cast("int") - 5).alias("expiry"),
    )


def _us(stream):
    return u_sql(stream, _LKS)


SHOTS = f"""shots AS (SELECT {', '.join(_LK)},
    CASE WHEN {_us('flag')} >= 0.05 THEN l_returnflag = 'R' END AS given,
    CASE WHEN l_returnflag = 'R' AND {_us('product')} < 0.9 THEN l_linestatus END AS product,
    CASE WHEN l_returnflag = 'R' OR {_us('day')} < 0.1 THEN CAST(date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS INTEGER)
      END AS day,
    CASE WHEN l_returnflag = 'R' THEN CAST(date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + floor({_us('span')} * 100) - 5
      AS INTEGER) END AS expiry FROM lineitem)"""
_SHOT_OK = """((coalesce(given, false) AND product IS NOT NULL AND day IS NOT NULL AND expiry IS NOT NULL AND day < expiry)
    OR (NOT coalesce(given, false) AND product IS NULL AND day IS NULL AND expiry IS NULL))"""


def shot_rule():
    return con.SubRecordConstraint("given", ["product", "day", "expiry"], ("day", "expiry"))


@add("con_subrecord", f"WITH {SHOTS} SELECT * FROM shots WHERE {_SHOT_OK}")
def _(spark, d):
    return con.keep_valid(shots(spark, d), [shot_rule()])


@add(
    "con_report",
    f"""WITH {OUTCOMES}, {SHOTS}, {CUSTOMER_SYN}
        SELECT 'outcome' AS "constraint", count(*) AS rows, count(*) FILTER (NOT {_OUTCOME_OK}) AS violations FROM outcomes
        UNION ALL SELECT 'sub_record', count(*), count(*) FILTER (NOT {_SHOT_OK}) FROM shots
        UNION ALL SELECT 'combination', count(*), count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer o WHERE
            o.c_nationkey = s.c_nationkey AND o.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment)) FROM customer_syn s""",
)
def _(spark, d):
    seen = con.FixedCombinations(["c_nationkey", "c_mktsegment"], table(spark, d, "customer"))
    out = con.validate_constraints(outcomes(spark, d), [outcome_rule()])
    out = out.unionByName(con.validate_constraints(shots(spark, d), [shot_rule()]))
    return out.unionByName(con.validate_constraints(customer_syn(spark, d), [seen]))


_CAT, _NUM, _BINS = ["p_brand", "p_type", "p_size"], ["p_retailprice"], 20


def fitted(spark, d, method="marginal"):
    return syn.fit(table(spark, d, "part"), _CAT, _NUM, method=method, bins=_BINS)


def _marginals(base="part", key="p_partkey", tail=""):
    steps, last = [], base
    for i, c in enumerate(_CAT):
        cols = f"e.{key}" if i == 0 else "e.*"
        steps.append(f"m{i} AS (SELECT {cols}, c.{c} FROM {last} e JOIN {_draw(c, key, c, 'part')})")
        last = f"m{i}"
    probs = ", ".join(f"{i / _BINS!r}" for i in range(_BINS + 1))
    return f"""WITH edges AS (SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [{probs}]))) AS g FROM part),
      bins AS (SELECT len(list_filter(g[2:-2], lambda e: e < p_retailprice)) AS b FROM part, edges),
      ids AS (SELECT unnest(range(0, 8 * (SELECT count(*) FROM part))) AS id),
      {', '.join(steps)},
      drawn AS (SELECT e.*, c.b FROM {last} e JOIN {_draw('b', key, 'p_retailprice', 'bins')}),
      made AS (SELECT {key}, p_brand, p_type, p_size,
        g[b + 1] + (g[b + 2] - g[b + 1]) * {u_sql('p_retailprice/in', key)} AS p_retailprice FROM drawn, edges)
      SELECT * REPLACE (round(p_retailprice, 4) AS p_retailprice) FROM made {tail}"""


def _sampled(model, spark, d):
    return rounded(model.sample(table(spark, d, "part").select("p_partkey"), SEED, "p_partkey"), 4)


@add("syn_marginals", _marginals())
def _(spark, d):
    return _sampled(fitted(spark, d), spark, d)


@add(
    "syn_marginals_fine",
    f"SELECT e.o_orderkey, c.o_custkey FROM orders e JOIN {_draw('o_custkey', 'o_orderkey', 'o_custkey', 'orders')}",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return syn.fit(o, ["o_custkey"]).sample(o.select("o_orderkey"), SEED, "o_orderkey")


def _tree_sql():
    """Mutual information, the spanning tree grown from the first column, and each column drawn given its parent."""
    probs = ", ".join(f"{i / _BINS!r}" for i in range(_BINS + 1))
    u = f"(('0x' || substr(md5('{SEED}:' || k.c || ':' || cast({{}} AS VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    covers = "floor({0} * k.total) < k.hi AND floor({0} * k.total) >= k.hi - k.n"
    ranks = ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS {c}" for c in _CAT)
    codes = ", ".join(f"max(code) FILTER (col = '{c}') AS {c}" for c in [*_CAT, *_NUM])
    names = " ".join(f"JOIN (SELECT DISTINCT {c} AS value, dense_rank() OVER (ORDER BY {c}) AS code FROM part) v{i} ON v{i}.code = m.{c}" for i, c in enumerate(_CAT))
    return f"""WITH RECURSIVE edges AS (SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [{probs}]))) AS g FROM part),
      src AS (SELECT p_partkey AS id, {ranks}, 1 + len(list_filter(g[2:-2], lambda e: e < p_retailprice)) AS p_retailprice FROM part, edges),
      long AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS col, {c}::BIGINT AS code FROM src" for c in [*_CAT, *_NUM])}),
      one AS (SELECT col, code, count(*) AS n FROM long GROUP BY ALL),
      two AS (SELECT a.col AS p, a.code AS pc, b.col AS c, b.code AS cc, count(*) AS n
              FROM long a JOIN long b ON a.id = b.id AND a.col <> b.col GROUP BY ALL),
      info AS (SELECT p, c, sum(t.n / rows * ln(t.n * rows / (x.n * y.n))) AS w FROM two t
               JOIN one x ON x.col = t.p AND x.code = t.pc JOIN one y ON y.col = t.c AND y.code = t.cc,
               (SELECT count(*)::DOUBLE AS rows FROM part) GROUP BY ALL),
      tree AS (SELECT ['p_brand'] AS linked, NULL::VARCHAR AS parent, 'p_brand' AS child
               UNION ALL
               SELECT list_append(t.linked, e[3]), e[2], e[3] FROM (
                 SELECT linked, (SELECT max([printf('%020.15f', w), p, c]) FROM info
                   WHERE list_contains(linked, p) AND NOT list_contains(linked, c)) AS e FROM tree) t WHERE e IS NOT NULL),
      cells AS (SELECT NULL::VARCHAR AS p, 0 AS pc, col AS c, code AS cc, n, sum(n) OVER (ORDER BY code) AS hi, sum(n) OVER () AS total
                FROM one WHERE col = 'p_brand'
                UNION ALL
                SELECT p, pc, c, cc, n, sum(n) OVER (PARTITION BY p, c, pc ORDER BY cc), sum(n) OVER (PARTITION BY p, c, pc)
                FROM two JOIN tree ON p = parent AND c = child),
      drawn AS (SELECT i.p_partkey AS id, k.c AS col, k.cc AS code FROM part i JOIN cells k ON k.p IS NULL AND {covers.format(u.format('i.p_partkey'))}
                UNION ALL
                SELECT s.id, k.c, k.cc FROM drawn s JOIN cells k ON k.p = s.col AND k.pc = s.code AND {covers.format(u.format('s.id'))}),
      made AS (SELECT id, {codes} FROM drawn GROUP BY id)
      SELECT m.id AS p_partkey, {', '.join(f'v{i}.value AS {c}' for i, c in enumerate(_CAT))},
        round(g[m.p_retailprice] + (g[m.p_retailprice + 1] - g[m.p_retailprice]) * {u_sql('p_retailprice/in', 'm.id')}, 4) AS p_retailprice
      FROM made m {names}, edges"""


@add("syn_tree", _tree_sql())
def _(spark, d):
    return _sampled(fitted(spark, d, "tree"), spark, d)


@add(
    "syn_fixed_combinations",
    f"""WITH cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
      k AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey, n_regionkey) AS idx
            FROM (SELECT DISTINCT n_nationkey, n_regionkey FROM cn)),
      src AS (SELECT idx, c_mktsegment FROM cn JOIN k USING (n_nationkey, n_regionkey)),
      a AS (SELECT e.c_custkey, c.idx FROM customer e JOIN {_draw('idx', 'c_custkey', 'n_nationkey+n_regionkey', 'src')}),
      b AS (SELECT e.*, c.c_mktsegment FROM a e JOIN {_draw('c_mktsegment', 'c_custkey', 'c_mktsegment', 'src')})
      SELECT c_custkey, n_nationkey, n_regionkey, c_mktsegment FROM b JOIN k USING (idx)""",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    model = syn.fit(rows, ["c_mktsegment"], fixed=[["n_nationkey", "n_regionkey"]])
    return model.sample(c.select("c_custkey"), SEED, "c_custkey")


@add(
    "syn_rejection",
    _marginals("ids", "id", "WHERE p_size > 10 AND made.p_retailprice > (SELECT (min(p_retailprice) + max(p_retailprice)) / 2 FROM part) ORDER BY id LIMIT (SELECT count(*) FROM part)"),
)
def _(spark, d):
    part = table(spark, d, "part")
    low, high = part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    rule = con.RowConstraint(f"p_size > 10 AND p_retailprice > {(low + high) / 2!r}D", "large")
    model = syn.fit(part, _CAT, _NUM, bins=_BINS)
    return rounded(syn.sample_valid(model, spark, model.rows, [rule], SEED), 4)


# Rules over brand, type and size are worked into the model: their 1 in some hundred combinations are drawn directly.
_RARE = "p_brand LIKE 'Brand#1%' AND p_size < 5 AND length(p_type) % 5 = 1"


@add(
    "syn_conditioned",
    f"""WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
      z AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1),
      cells AS (SELECT p_brand, p_type, p_size, b.n * t.n * z.n AS n FROM b, t, z WHERE {_RARE}),
      runs AS (SELECT *, sum(n) OVER (ORDER BY p_brand, p_type, p_size) AS hi FROM cells),
      ids AS (SELECT unnest(range(0, 3000)) AS id),
      spots AS (SELECT id, floor({u_sql('p_brand&p_type&p_size', 'id')} * (SELECT sum(n) FROM cells)::DOUBLE)::HUGEINT AS pos FROM ids)
      SELECT id, p_brand, p_type, p_size FROM spots JOIN runs ON pos < hi AND pos >= hi - n""",
)
def _(spark, d):
    model = syn.fit(table(spark, d, "part"), _CAT)
    rules = [con.RowConstraint(r, r) for r in _RARE.split(" AND ")[:2]] + [con.RowConstraint(_RARE, "all")]
    return syn.sample_valid(model, spark, 3000, rules, SEED)


@add("syn_model_roundtrip", _marginals())
def _(spark, d):
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    fitted(spark, d).save(path)
    return _sampled(syn.Model.load(spark, path), spark, d)
