"""Equivalence classes: k-anonymity, l-diversity, t-closeness and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.operators.joins import attach
from twinlake.operators.rank import carried_forward, global_cumulative
from twinlake.sources.scratch import materialize

# Up to this many ordered levels the distance is summed over a literal-size array.
DENSE_LEVELS = 1000
# A share of more runs than this is looked up in a table of its own.
HOT_SHARE = 100_000


def class_sizes(df: DataFrame, qi: list[str], name: str = "size") -> DataFrame:
    return df.groupBy(*qi).agg(F.count(F.lit(1)).alias(name))


def suppress_small_groups(df: DataFrame, qi: list[str], min_size: int) -> DataFrame:
    """Keep rows whose group has more than ``min_size`` rows; NULL keys are dropped.

    The group sizes are written first: they are small next to the rows, and with
    their size known Spark can keep the rows in place instead of shuffling them.
    """
    kept = materialize(
        class_sizes(df.dropna(subset=qi), qi).filter(F.col("size") > min_size).select(*qi)
    )
    return df.join(kept, qi, "left_semi").select(*df.columns)


def suppress_min_distinct(
    df: DataFrame, group: str, member: str, order, n: int, drop_zero: bool = False
) -> DataFrame:
    """Drop groups in which fewer than ``n`` members have their first row.

    A member counts only in the group of its first row by ``order``. A group
    with no first row at all is kept unless ``drop_zero``.
    """
    orders = [order] if isinstance(order, str) else list(order)
    first = F.col(orders[0]) if len(orders) == 1 else F.struct(*orders)
    firsts = df.groupBy(member).agg(F.min_by(group, first).alias("__g"))
    counts = firsts.filter(F.col("__g").isNotNull()).groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    if drop_zero:
        keep = materialize(counts.filter(F.col("__n") >= n).select(F.col("__g").alias(group)))
        return df.join(keep, group, "left_semi").select(*df.columns)
    bad = materialize(counts.filter(F.col("__n") < n).select(F.col("__g").alias(group)))
    return df.join(bad, group, "left_anti").select(*df.columns)


def k_anonymity(df: DataFrame, qi: list[str]) -> DataFrame:
    """One row: the size of the smallest class and the number of classes."""
    return class_sizes(df, qi).agg(
        F.min("size").alias("k"), F.count(F.lit(1)).alias("classes"), F.sum("size").alias("rows")
    )


def class_distinct(df: DataFrame, qi: list[str], sa: list[str]) -> DataFrame:
    """Distinct values of each sensitive column per class, a NULL being one value."""
    counts = [
        (F.count_distinct(F.col(s)) + F.max(F.col(s).isNull().cast("long"))).alias(f"l_{s}") for s in sa
    ]
    return df.groupBy(*qi).agg(F.count(F.lit(1)).alias("size"), *counts)


def l_diversity(df: DataFrame, qi: list[str], sa: list[str]) -> DataFrame:
    """One row: the smallest number of distinct sensitive values in any class."""
    per_class = class_distinct(df, qi, sa)
    names = [F.col(f"l_{s}") for s in sa]
    least = names[0] if len(names) == 1 else F.least(*names)
    return per_class.agg(F.min(least).alias("l"))


def class_t(df: DataFrame, qi: list[str], sa: str, kind: str = "categorical") -> DataFrame:
    """Distance of each class's distribution of ``sa`` from the whole table's: ``qi``, ``t``.

    Categorical values use the total variation distance, ordered ones the
    earth mover's distance over the ranks of the distinct values. Only observed
    (class, value) cells are built: values a class lacks are added in closed form.
    """
    if kind not in ("categorical", "ordered"):
        raise ValueError("kind is 'categorical' or 'ordered'")
    src = df if kind == "categorical" else df.filter(F.col(sa).isNotNull())
    cells = materialize(src.groupBy(*qi, F.col(sa).alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    levels = cells.groupBy("__v").agg(F.sum("__n").alias("__q"))
    if kind == "categorical":
        whole = materialize(levels.withColumnRenamed("__v", "__w"))
        total = whole.agg(F.sum("__q").alias("s")).scalar()
        sizes = cells.groupBy(*qi).agg(F.sum("__n").alias("__size"))
        joined = attach(cells.join(whole, F.col("__v").eqNullSafe(F.col("__w"))), sizes, qi)
        p = F.col("__n") / F.col("__size")
        q = F.col("__q") / total
        cell = joined.select(*qi, p.alias("__p"), q.alias("__q"))
        t = (F.sum(F.abs(F.col("__p") - F.col("__q"))) + 1 - F.sum("__q")) / 2
        return cell.groupBy(*qi).agg(t.alias("t"))
    return _ordered_t(cells, levels, qi)


def _ordered_t(cells: DataFrame, levels: DataFrame, qi: list[str]) -> DataFrame:
    whole, m, total = global_cumulative(levels, "__v", "__q")
    names = {"__v": "__w", "rank": "__rank", "cum": "__cum", "cum_cum": "__cum_cum"}
    whole = materialize(whole.withColumnsRenamed(names))
    placed = cells.join(whole, F.col("__v") == F.col("__w"))
    runs = _runs_by_window(placed, qi) if m <= DENSE_LEVELS else _runs_by_rank(placed, qi)
    if m <= DENSE_LEVELS:
        shares = whole.select("__rank", "__cum").collect()  # DENSE_LEVELS rows at most
        steps = F.array(*[F.lit(r["__cum"] / total) for r in sorted(shares)])
        width = (F.coalesce(F.col("__next"), F.lit(m + 1)) - F.col("__rank")).cast("int")
        part = F.aggregate(
            F.slice(steps, F.col("__rank").cast("int"), width),
            F.lit(0.0),
            lambda acc, q: acc + F.abs(F.col("__c") - q),
        )
        runs = runs.withColumn("__part", part)
    else:
        runs = _run_distance(runs, whole, m, total)
    before = F.when(F.col("__first"), (F.col("__cum_cum") - F.col("__cum")) / F.lit(float(total))).otherwise(0.0)
    t = F.sum(F.col("__part") + before) / F.lit(float(max(m - 1, 1)))
    return runs.groupBy(*qi).agg(t.alias("t"))


def _runs_by_window(placed: DataFrame, qi: list[str]) -> DataFrame:
    """Each cell stands for its level and the levels up to the class's next one.

    For few levels only: a class then has at most DENSE_LEVELS cells.
    """
    in_order = Window.partitionBy(*qi).orderBy("__rank")
    return placed.withColumns(
        {
            "__c": F.sum("__n").over(in_order) / F.sum("__n").over(Window.partitionBy(*qi)),
            "__next": F.lead("__rank").over(in_order),
            "__next_cum": F.lead("__cum").over(in_order),
            "__next_cum_cum": F.lead("__cum_cum").over(in_order),
            "__first": F.row_number().over(in_order) == 1,
        }
    )


def _runs_by_rank(placed: DataFrame, qi: list[str]) -> DataFrame:
    """The same without gathering a class: running sums over all cells, next cell by number."""
    names = {"rank": "__g", "cum": "__run"}
    numbered, _, _ = global_cumulative(placed, [*qi, "__rank"], "__n")
    numbered = materialize(numbered.drop("cum_cum").withColumnsRenamed(names))
    spans = numbered.groupBy(*qi).agg(
        F.min("__g").alias("__start"),
        F.max("__g").alias("__end"),
        F.min(F.col("__run") - F.col("__n")).alias("__before"),
        F.sum("__n").alias("__size"),
    )
    following = numbered.select(
        (F.col("__g") - 1).alias("__g"),
        F.col("__rank").alias("__next"),
        F.col("__cum").alias("__next_cum"),
        F.col("__cum_cum").alias("__next_cum_cum"),
    )
    runs = attach(numbered, spans, qi).join(following, "__g", "left")
    last = F.col("__g") == F.col("__end")
    ends = {c: F.when(~last, F.col(c)) for c in ("__next", "__next_cum", "__next_cum_cum")}
    return runs.withColumns(
        {
            **ends,
            "__c": (F.col("__run") - F.col("__before")) / F.col("__size"),
            "__first": F.col("__g") == F.col("__start"),
        }
    )


def _run_distance(runs: DataFrame, whole: DataFrame, m: int, total: int) -> DataFrame:
    """Sum of |c - Q(j)| over each run of levels, from prefix sums instead of a grid.

    Q only grows, so the run splits where Q passes c. That place is found by an
    as-of lookup of c among the cumulative shares, both in ranges of rows. The last
    run of a class ends at c = 1, which is the last level. Shares that many runs have
    are few and joined first; those runs then take part in the join of the rest
    under keys of their own, which match nothing.
    """
    one = float(total)
    share = whole.select((F.col("__cum") / one).alias("__u"), F.col("__rank").alias("__k"), F.col("__cum_cum").alias("__kk"))
    looked_up = runs.filter("__c < 1").groupBy(F.col("__c").alias("__u")).agg(F.count(F.lit(1)).alias("__times"))
    empty_k = F.lit(None).cast("long").alias("__k"), F.lit(None).cast("double").alias("__kk")
    both = share.withColumn("__times", F.lit(None).cast("long")).unionByName(looked_up.select("__u", *empty_k, "__times"))
    # of a level and a lookup at the same share the level comes first: NULLs sort first
    filled = carried_forward(both, ["__u", "__times"], ["__k", "__kk"]).filter("__times IS NOT NULL")
    split = materialize(filled)
    hot = split.filter(F.col("__times") > HOT_SHARE)
    hot = materialize(hot.select(F.col("__u").alias("__h"), F.col("__k").alias("__hot_k"), F.col("__kk").alias("__hot_kk")))
    marked = runs.join(hot, F.col("__c") == F.col("__h"), "left")
    last, known = F.col("__c") >= 1, F.col("__h").isNotNull()
    own_key = F.when(last | known, -F.col("__g").cast("double")).otherwise(F.col("__c"))
    placed = marked.withColumn("__key", own_key).join(split, F.col("__key") == F.col("__u"), "left")
    lo, hi = F.col("__rank"), F.coalesce(F.col("__next") - 1, F.lit(m))
    lo_sum = F.col("__cum_cum") - F.col("__cum")  # prefix sum before the run
    end = whole.agg(F.max("__cum_cum").alias("s")).scalar()
    hi_sum = F.coalesce(F.col("__next_cum_cum") - F.col("__next_cum"), end)
    k = F.when(last, F.lit(m)).otherwise(F.coalesce("__hot_k", "__k"))
    kk = F.when(last, end).otherwise(F.coalesce("__hot_kk", "__kk"))
    mid = F.greatest(lo - 1, F.least(hi, k))
    mid_sum = F.when(k < lo, lo_sum).when(k > hi, hi_sum).otherwise(kk)
    below_c = F.col("__c") * (mid - lo + 1) - (mid_sum - lo_sum) / one
    above_c = (hi_sum - mid_sum) / one - F.col("__c") * (hi - mid)
    return placed.withColumn("__part", below_c + above_c)


def t_closeness(df: DataFrame, qi: list[str], sa: dict[str, str]) -> DataFrame:
    """One row per sensitive column: the largest distance over the classes."""
    out = None
    for col, kind in sa.items():
        one = class_t(df, qi, col, kind).agg(F.max("t").alias("t")).select(F.lit(col).alias("attribute"), "t")
        out = one if out is None else out.unionByName(one)
    return out


def class_report(df: DataFrame, qi: list[str], sa: dict[str, str]) -> DataFrame:
    """Per class: size, distinct sensitive values and distance of each sensitive column."""
    out = class_distinct(df, qi, list(sa))
    for col, kind in sa.items():
        t = class_t(df, qi, col, kind).withColumnRenamed("t", f"t_{col}")
        out = attach(out, t, qi, "left")
    return out
