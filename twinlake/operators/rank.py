"""Total order over a distributed table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.rand import as_column
from twinlake.sources.scratch import materialize

_PID, _POS = "__pid", "__pos"


def range_sorted(df: DataFrame, *order) -> DataFrame:
    """Range-partition and sort, then pin each row's partition and position.

    The result is a written table, so the partition borders cannot move between
    two uses of it.
    """
    cols = [as_column(c) for c in order]
    placed = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn(_POS, F.monotonically_increasing_id())
        .withColumn(_PID, F.shiftright(_POS, 33).cast("int"))
        .withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(placed)


def _by_partition(values: dict[int, float | int], kind: str) -> Column:
    """Look up a per-partition number; the list is as long as the shuffle has partitions."""
    top = max(values, default=-1)
    arr = F.array(*[F.lit(values.get(p, 0)).cast(kind) for p in range(top + 1)])
    return F.element_at(arr, F.col(_PID) + 1)


def global_rank(df: DataFrame, *order, name: str = "rank") -> tuple[DataFrame, int]:
    """Add the 1-based rank by ``order`` (a unique key) and return it with the row count."""
    placed = range_sorted(df, *order)
    sizes = {r[0]: r[1] for r in placed.groupBy(_PID).count().collect()}
    offsets, run = {}, 0
    for p in sorted(sizes):
        offsets[p] = run
        run += sizes[p]
    ranked = placed.withColumn(name, _by_partition(offsets, "long") + F.col(_POS) + 1)
    return ranked.drop(_PID, _POS), run


def global_cumulative(df: DataFrame, order, weight: str) -> tuple[DataFrame, int, int]:
    """Add ``rank``, ``cum`` (running weight) and ``cum_cum`` (running sum of ``cum``).

    ``order`` is a unique key: a column or a list. Returns the table, the row
    count and the total weight.
    """
    placed = range_sorted(df, *(order if isinstance(order, list) else [order]))
    w = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("cum", F.sum(F.col(weight).cast("long")).over(w)).withColumn(
        "cum_cum", F.sum(F.col("cum").cast("double")).over(w)
    )
    totals = (
        local.groupBy(_PID)
        .agg(F.count(F.lit(1)).alias("rows"), F.max("cum").alias("w"), F.max("cum_cum").alias("ww"))
        .collect()
    )
    row_off, w_off, ww_off = {}, {}, {}
    rows, weight_sum, ww_sum = 0, 0, 0.0
    for r in sorted(totals, key=lambda r: r[_PID]):
        p = r[_PID]
        row_off[p], w_off[p], ww_off[p] = rows, weight_sum, ww_sum
        ww_sum += r["ww"] + weight_sum * r["rows"]
        rows += r["rows"]
        weight_sum += r["w"]
    out = local.withColumns(
        {
            "rank": _by_partition(row_off, "long") + F.col(_POS) + 1,
            "cum": F.col("cum") + _by_partition(w_off, "long"),
            "cum_cum": F.col("cum_cum")
            + _by_partition(ww_off, "double")
            + _by_partition(w_off, "double") * (F.col(_POS) + 1),
        }
    )
    return out.drop(_PID, _POS), rows, weight_sum


def carried_forward(df: DataFrame, order: list, cols: list[str]) -> DataFrame:
    """Fill the NULLs of ``cols`` with the last value before them by ``order``, or 0.

    The columns are numbers that never fall along ``order``. Partitions are ranges
    of rows, so their sizes do not depend on how the values are spread.
    """
    placed = range_sorted(df, *order)
    tops = placed.groupBy(_PID).agg(*[F.max(c).alias(c) for c in cols]).collect()  # one row per partition
    w = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for c in cols:
        before, run = {}, 0
        for r in sorted(tops, key=lambda r: r[_PID]):
            before[r[_PID]] = run
            run = run if r[c] is None else r[c]
        kind = df.schema[c].dataType.simpleString()
        filled[c] = F.coalesce(F.last(c, True).over(w), _by_partition(before, kind))
    return placed.withColumns(filled).drop(_PID, _POS)


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``by``, ``prob``, ``quantile``.

    Values are counted first, so repeated values shrink before the shuffle, then
    range-partitioned. Only the partitions that hold a wanted position are read
    again. NULL values and groups are skipped. With ``weight`` the rows are already counted, one per group and value.
    """
    known = df.filter(F.col(value).isNotNull())
    if weight is None:
        counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    else:
        counts = known.select(*by, value, F.col(weight).alias("__n"))
    placed = range_sorted(counts, *by, value)
    # a group has at most one row per partition
    in_order = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*by, _PID).agg(F.sum("__n").alias("__n"))
    parts = sums.withColumns(
        {"__end": F.sum("__n").over(in_order), "__total": F.sum("__n").over(Window.partitionBy(*by))}
    ).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    spot = (F.col("__total") - 1) * F.col("prob")
    ends = F.array(F.floor(spot), F.least(F.floor(spot) + 1, F.col("__total") - 1))
    targets = materialize(
        parts.withColumn("__spot", F.explode(F.array_distinct(ends)))
        .filter((F.col("__spot") < F.col("__end")) & (F.col("__spot") >= F.col("__end") - F.col("__n")))
        .select(
            *by,
            _PID,
            (F.col("__spot") - F.col("__end") + F.col("__n")).alias("__at"),
            "prob",
            (1 - F.abs(spot - F.col("__spot"))).alias("__share"),
        )
        .filter("__share > 0")  # an infinite value times nothing would be NaN
    )
    w = Window.partitionBy(*by, _PID).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        placed.join(targets.select(_PID).distinct(), _PID, "left_semi")
        .withColumn("__hi", F.sum("__n").over(w))
        .join(targets, [*by, _PID])
        .filter((F.col("__at") < F.col("__hi")) & (F.col("__at") >= F.col("__hi") - F.col("__n")))
    )
    return hits.groupBy(*by, "prob").agg(
        F.sum(F.col(value).cast("double") * F.col("__share")).alias("quantile")
    )
