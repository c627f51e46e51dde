"""Frequent itemsets and association rules of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import LINEITEM_SYN, Family, lineitem_syn, table
from twinlake.operators import basket
from twinlake.operators.aggregate import rounded

family = Family()
add = family.add


def purchases(spark, d, lines, item):
    part = table(spark, d, "part").select("p_partkey", item)
    qty = (F.col("l_quantity") - 10).alias("qty")
    return lines.select("l_orderkey", "l_partkey", qty).join(part, F.col("l_partkey") == F.col("p_partkey"))


def _pairs(src, item, name):
    return f"""{name} AS (SELECT l_orderkey, {item} AS item FROM {src} JOIN part ON l_partkey = p_partkey
      WHERE l_quantity - 10 > 0 GROUP BY 1, 2 HAVING sum(l_quantity - 10) >= 1
      QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 2)"""


def _itemsets(pairs, name, support):
    return f"""{name}_b AS (SELECT list(item ORDER BY item) AS its FROM {pairs} GROUP BY l_orderkey),
    {name}_n AS (SELECT count(*)::DOUBLE AS n FROM {name}_b),
    {name} AS (SELECT items, count(*) AS freq, count(*) / (SELECT n FROM {name}_n) AS support FROM (
        SELECT list_filter(its, lambda x, i: (m >> (i - 1)::BIGINT) & 1 = 1) AS items
        FROM (SELECT its, unnest(range(1, (1 << len(its))::BIGINT)) AS m FROM {name}_b))
      GROUP BY 1 HAVING count(*) / (SELECT n FROM {name}_n) >= {support})"""


def _rules(itemsets, name, lift):
    return f"""{name}_s AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)::BIGINT) & 1 = 1) AS ante,
        list_filter(items, lambda x, i: (m >> (i - 1)::BIGINT) & 1 = 0) AS cons, support
      FROM (SELECT items, support, unnest(range(1, (1 << len(items))::BIGINT - 1)) AS m FROM {itemsets}
            WHERE len(items) >= 2)),
    {name}_m AS (SELECT ante, cons, a.support AS sa, c.support AS sc, s.support AS s, s.support / a.support AS conf
      FROM {name}_s s JOIN {itemsets} a ON a.items = ante JOIN {itemsets} c ON c.items = cons),
    {name} AS (SELECT *, conf / sc AS lift FROM {name}_m WHERE conf / sc >= {lift})"""


def mined(spark, d, item, support):
    pairs = basket.baskets(purchases(spark, d, table(spark, d, "lineitem"), item), "l_orderkey", item, "qty")
    return basket.frequent_itemsets(pairs, "l_orderkey", item, support)[0]


@add(
    "basket_matrix",
    f"WITH {_pairs('lineitem', 'p_brand', 'p')} SELECT l_orderkey, item AS p_brand FROM p",
)
def _(spark, d):
    return basket.baskets(purchases(spark, d, table(spark, d, "lineitem"), "p_brand"), "l_orderkey", "p_brand", "qty")


@add(
    "basket_itemsets",
    f"""WITH {_pairs('lineitem', 'p_type', 'p')}, {_itemsets('p', 'f', 0.05)}
        SELECT array_to_string(items, '|') AS items, len(items)::INTEGER AS size, freq, round(support, 6) AS support FROM f""",
)
def _(spark, d):
    return rounded(mined(spark, d, "p_type", 0.05)).withColumn("items", F.concat_ws("|", "items"))


@add(
    "basket_rules",
    f"""WITH {_pairs('lineitem', 'p_type', 'p')}, {_itemsets('p', 'f', 0.05)}, {_rules('f', 'r', 0.8)}
        SELECT array_to_string(ante, '|') AS antecedents, array_to_string(cons, '|') AS consequents,
          round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support, round(s, 6) AS support,
          round(conf, 6) AS confidence, round(lift, 6) AS lift, round(s - sa * sc, 6) AS leverage,
          round(CASE WHEN conf < 1 THEN (1 - sc) / (1 - conf) ELSE 'inf'::DOUBLE END, 6) AS conviction FROM r""",
)
def _(spark, d):
    rules = basket.association_rules(mined(spark, d, "p_type", 0.05), "lift", 0.8)
    return rounded(rules).withColumns(
        {c: F.concat_ws("|", c) for c in ("antecedents", "consequents")}
    )


@add(
    "basket_rule_retention",
    f"""WITH {LINEITEM_SYN}, {_pairs('lineitem', 'p_brand', 'p')}, {_itemsets('p', 'f', 0.01)}, {_rules('f', 'r', 1.0)},
        {_pairs('lineitem_syn', 'p_brand', 'p2')}, {_itemsets('p2', 'f2', 0.01)}, {_rules('f2', 'r2', 1.0)}
        SELECT count(*) AS rules, count(r2.ante) AS matched,
               round(CASE WHEN count(*) > 0 THEN count(r2.ante) / count(*)::DOUBLE ELSE 0 END, 6) AS retention
        FROM r LEFT JOIN r2 ON r.ante = r2.ante AND r.cons = r2.cons""",
)
def _(spark, d):
    sides = [
        basket.mine_rules(purchases(spark, d, lines, "p_brand"), "l_orderkey", "p_brand", "qty", 0.01, 1.0)
        for lines in (table(spark, d, "lineitem"), lineitem_syn(spark, d))
    ]
    return rounded(basket.rule_retention(*sides))
