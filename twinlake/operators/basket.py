"""Baskets, frequent itemsets, association rules and how many rules survive.

Baskets stay in long form (basket, item). Only items that are frequent on
their own are ever gathered into arrays, so an array is as long as the number
of frequent items at most, however many rows a basket has.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.operators.clean import positive_only
from twinlake.sources.scratch import materialize


def baskets(df: DataFrame, basket: str, item: str, qty: str, min_items: int = 2) -> DataFrame:
    """Distinct (basket, item) pairs bought at least once, for baskets of two items or more."""
    known = positive_only(df.dropna(subset=[basket, item]), qty)
    pairs = (
        known.groupBy(basket, item)
        .agg(F.sum(qty).alias("__q"))
        .filter(F.col("__q") >= 1)
        .select(basket, item)
    )
    # counted beside the pairs, so they are shuffled once more and not twice
    sized = pairs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(basket)))
    return sized.filter(F.col("__n") >= min_items).select(basket, item)


def frequent_itemsets(pairs: DataFrame, basket: str, item: str, min_support: float) -> tuple[DataFrame, int]:
    """Itemsets in at least ``min_support`` of the baskets: ``items`` (sorted), ``size``, ``freq``, ``support``.

    Also returns the number of baskets. Counted level by level (Apriori): equal baskets are counted as one with their
    number, and only sets whose subsets are all frequent are counted.
    """
    pairs = materialize(pairs)
    n = pairs.select(basket).distinct().count()
    spark = pairs.sparkSession
    kind = pairs.schema[item].dataType.simpleString()
    if n == 0:
        return spark.createDataFrame([], f"items array<{kind}>, size int, freq bigint, support double"), 0
    need = max(1, math.ceil(min_support * n - 1e-9))
    frequent = materialize(
        pairs.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= need).select(item)
    )
    held = pairs.join(frequent, item, "left_semi").groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("items"))
    # equal baskets are one row with their number
    kinds = materialize(held.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    first = kinds.select("n", F.explode("items").alias("x")).groupBy(F.array("x").alias("items")).agg(F.sum("n").alias("freq"))
    found = [materialize(first)]
    sets = kinds.select("items", "n", F.explode("items").alias("x")).select("items", "n", F.array("x").alias("set"))
    while not found[-1].isEmpty():
        # every set grows by the items of its basket behind its last one, so each is met once a basket
        more = F.filter("items", lambda x: x > F.element_at("set", -1))
        grown = sets.select("items", "n", "set", F.explode(more).alias("x"))
        grown = grown.select("items", "n", F.concat("set", F.array("x")).alias("set"))
        wanted = _candidates(found[-1])
        grown = grown.join(wanted, "set", "left_semi")
        often = grown.groupBy("set").agg(F.sum("n").alias("freq")).filter(F.col("freq") >= need)
        found.append(materialize(often.withColumnRenamed("set", "items")))
        sets = materialize(grown.join(found[-1].select(F.col("items").alias("set")), "set", "left_semi"))
    all_ = reduce(DataFrame.unionByName, found)
    return materialize(all_.select("items", F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(n)).alias("support"))), n


def _candidates(frequent: DataFrame) -> DataFrame:
    """The sets (``set``, written) of one item more whose subsets of one item less are all in ``frequent`` (sets of one size)."""
    known = frequent.select("items", F.slice("items", 1, F.size("items") - 1).alias("__head"), F.element_at("items", -1).alias("__last"))
    other = known.select("__head", F.col("__last").alias("__next"))
    grown = known.join(other, "__head").filter(F.col("__last") < F.col("__next"))
    grown = grown.select(F.concat("items", F.array("__next")).alias("set"))
    # a set of k items has k subsets of k - 1
    subsets = grown.select("set", F.posexplode("set").alias("__at", "__x"))
    subsets = subsets.select("set", F.concat(F.expr("slice(set, 1, __at)"), F.expr("slice(set, __at + 2, size(set))")).alias("items"))
    met = subsets.join(frequent.select("items"), "items", "left_semi").groupBy("set").agg(F.count(F.lit(1)).alias("__n"))
    return materialize(met.filter(F.col("__n") == F.size("set")).select("set"))


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float = 1.0) -> DataFrame:
    """Every split of every itemset into antecedents and consequents, with the usual measures.

    An itemset of k items gives 2^k - 2 rules, consequents of any size included.
    """
    # a mask of k bits in two halves, so that no array holds 2^k numbers
    halves = itemsets.filter(F.col("size") >= 2).withColumn("low", F.least(F.col("size"), F.lit(12)))
    upper = halves.withColumn("hi", F.explode(F.expr("sequence(0L, shiftleft(1L, size - low) - 1)")))
    both = upper.withColumn("lo", F.explode(F.expr("sequence(0L, shiftleft(1L, low) - 1)")))
    masks = both.select("items", "size", "support", F.expr("shiftleft(hi, low) | lo").alias("m"))
    split = masks.filter("m > 0 AND m < shiftleft(1L, size) - 1").select("items", "support", "m")

    picked = F.expr("filter(items, (x, k) -> (shiftright(m, k) & 1) = 1)")
    left = F.expr("filter(items, (x, k) -> (shiftright(m, k) & 1) = 0)")
    rules = split.select(picked.alias("antecedents"), left.alias("consequents"), "support")
    known = itemsets.select("items", "support")
    rules = rules.join(
        known.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support")), "antecedents"
    ).join(
        known.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support")), "consequents"
    )
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    rules = rules.withColumn("confidence", s / a)
    rules = rules.withColumns(
        {
            "lift": F.col("confidence") / c,
            "leverage": s - a * c,
            "conviction": F.when(F.col("confidence") < 1, (1 - c) / (1 - F.col("confidence"))).otherwise(
                F.lit(float("inf"))
            ),
        }
    )
    return rules.filter(F.col(metric) >= min_threshold).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support",
        "support", "confidence", "lift", "leverage", "conviction",
    )


def rule_retention(original: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rules of the original, how many the other side has too, and the share (0 without rules)."""
    keys = ["antecedents", "consequents"]
    theirs = other.select(*keys).distinct().withColumn("__hit", F.lit(1))
    got = original.select(*keys).distinct().join(theirs, keys, "left").agg(
        F.count(F.lit(1)).alias("rules"), F.count("__hit").alias("matched")
    )
    share = F.when(F.col("rules") > 0, F.col("matched") / F.col("rules")).otherwise(0.0)
    return got.withColumn("retention", share)


def mine_rules(
    df: DataFrame, basket: str, item: str, qty: str, min_support: float, min_lift: float
) -> DataFrame:
    """Rules straight from purchase rows."""
    itemsets, _ = frequent_itemsets(baskets(df, basket, item, qty), basket, item, min_support)
    return association_rules(itemsets, "lift", min_lift)
