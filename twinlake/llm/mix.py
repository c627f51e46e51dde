"""Mix sources to target weights by Pareto order sampling; DataFrame expressions only.

Every source gets a word target. A document's expected number of copies is proportional to its weight, at most
``cap``, and adds up to the target over the source. Its whole part is taken for certain; for the rest f the source's
documents are ranked by random odds over inclusion odds, (u / (1-u)) / (f / (1-f)), and the smallest are taken until
their words reach what the target still needs: a fixed-size sample with unequal inclusion probabilities.

A source is never sorted or windowed as a whole: ranks are first counted into 65 536 buckets per source, and only
the documents of the one bucket in which the target is reached are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.rand import uniform
from twinlake.sources.scratch import materialize

BUCKETS = 65_536
MANY_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float, cap: int, cycle: tuple[int, ...]) -> DataFrame:
    """(__source, __size) with __target: ``share`` of all words dealt by weight, none above ``cap`` times its size."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    wheel = F.array(*[F.lit(w) for w in cycle])
    weighed = sources.withColumn("__w", F.get(wheel, (F.row_number().over(order) - 1) % len(cycle)).cast("long"))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (F.sum("__size").over(whole) * share - F.col("__before")) / F.sum("__w").over(
        fill.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = (
        weighed.withColumn("__cap", F.lit(cap) * F.col("__size"))
        .withColumn(
            "__before", F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
        )
        .withColumn("__level", level)
        .withColumn("__open", F.when(F.col("__level") * F.col("__w") < F.col("__cap"), F.col("__level")))
    )
    target = F.least(F.col("__cap").cast("double"), F.max("__open").over(whole) * F.col("__w"))
    return filled.select("__source", "__size", F.coalesce(target, F.col("__cap").cast("double")).alias("__target"))


def copy_rate(levels: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """targets with __rate: the copies per unit of weight, NULL when every document is at the cap.

    ``levels`` has the words of each weight of each source, so its length is bounded by the number of weights.
    """
    by = Window.partitionBy("__source").orderBy(F.col("__x").desc())
    above = F.coalesce(F.sum("__words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("__x") * F.col("__words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    t = targets.select(F.col("__source").alias("__s"), "__target")
    rate = (
        levels.where("__x > 0 AND __words > 0")
        .withColumns({"__above": above, "__rest": rest})
        .join(t, F.col("__source").eqNullSafe(F.col("__s")))
        .withColumn("__c", (F.col("__target") - cap * F.col("__above").cast("double")) / F.col("__rest").cast("double"))
        .groupBy("__s")
        .agg(F.max(F.when(F.col("__c") * F.col("__x") < cap, F.col("__c"))).alias("__rate"))
    )
    return targets.join(rate, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")


def pareto_mix(
    docs: DataFrame,
    key: str,
    source: str,
    size: str,
    weight: str | None = None,
    share: float = 1.5,
    cap: int = 2,
    cycle: tuple[int, ...] = (3, 1, 2),
    seed: int = 7,
) -> DataFrame:
    """``docs`` with source_size, target and copies (0 to ``cap``).

    ``size`` is a long column of words and ``weight`` one of whole numbers (absent: all alike); both are taken as 0
    where NULL, and such a document is never taken. Keep the number of different weights bounded. Random numbers
    depend on ``key`` and ``seed`` only, so reruns agree; ties and repeated rows are taken one after the other. A
    NULL source is a source of its own. Columns of ``docs`` called source_size, target or copies are replaced.
    """
    words = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    heavy = F.lit(1).cast("long") if weight is None else F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long")
    wide = docs.withColumns({"__source": F.col(source), "__n": words, "__x": heavy})
    slim = materialize(wide.select("__source", "__n", "__x", F.col(key).alias("__key")))

    sources = materialize(slim.groupBy("__source").agg(F.sum("__n").alias("__size")))
    targets = source_targets(sources, share, cap, cycle)
    levels = slim.groupBy("__source", "__x").agg(F.sum("__n").alias("__words"))
    rates = materialize(copy_rate(levels, targets, cap))
    few = sources.count() <= MANY_SOURCES

    def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
        facts = facts.withColumnRenamed("__source", "__s")
        facts = F.broadcast(facts) if few else facts
        return rows.join(facts, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")

    def ranked(rows: DataFrame, key_col: str) -> DataFrame:
        mean = F.least(F.lit(float(cap)), F.coalesce(F.col("__rate") * F.col("__x"), F.lit(float(cap))))
        rows = with_facts(rows, rates).withColumn(
            "__mean", F.when((F.col("__n") > 0) & (F.col("__x") > 0), mean).otherwise(F.lit(0.0))
        )
        part, u = F.col("__mean") - F.floor("__mean"), uniform(seed, "pareto", key_col)
        odds = (u / (F.lit(1.0) - u)) / (part / (F.lit(1.0) - part))
        rows = rows.withColumn("__whole", F.floor("__mean").cast("long")).withColumn("__q", F.when(part > 0, odds))
        place = F.floor(F.col("__q") / (F.lit(1.0) + F.col("__q")) * BUCKETS)
        return rows.withColumn("__bucket", F.when(F.col("__q").isNotNull(), F.least(place, F.lit(BUCKETS - 1))).cast("int"))

    counted = ranked(slim, "__key")
    needs = counted.groupBy("__source").agg(
        (F.first("__target") - F.sum(F.col("__whole") * F.col("__n"))).alias("__need")
    )
    sums = counted.where("__bucket IS NOT NULL").groupBy("__source", "__bucket").agg(F.sum("__n").alias("__w"))
    up_to = Window.partitionBy("__source").orderBy("__bucket")
    reached = with_facts(sums.withColumn("__upto", F.sum("__w").over(up_to)), materialize(needs))
    edges = (
        reached.where(F.col("__upto") > F.col("__need"))
        .groupBy("__source")
        .agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__w")).alias("before"), "__need")).alias("__edge"))
    )
    full = with_facts(ranked(wide, key), materialize(edges))
    edge = F.col("__edge.__bucket")
    at_edge = F.coalesce(F.col("__bucket") == edge, F.lit(False))
    sure = full.where(~at_edge).withColumn(
        "__take", F.col("__bucket").isNotNull() & (edge.isNull() | (F.col("__bucket") < edge))
    )
    inside = Window.partitionBy("__source").orderBy("__q", key).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("__edge.before") + F.sum("__n").over(inside) - F.col("__n") / 2
    split = full.where(at_edge).withColumn("__take", middle < F.col("__edge.__need"))
    out = sure.unionByName(split)
    result = out.withColumns(
        {"target": F.col("__target"), "source_size": F.col("__size"), "copies": F.col("__whole") + F.col("__take").cast("long")}
    )
    made = ("source_size", "target", "copies")
    return result.select(*[c for c in docs.columns if c not in made], *made)
