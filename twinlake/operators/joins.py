"""Lookup, prefix and marker joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    on = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return on


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equally named columns with NULL equal to NULL, keeping the left side's key columns."""
    renamed = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    joined = left.join(renamed, null_safe(left, renamed, [(c, f"__on_{c}") for c in on]), how)
    return joined.drop(*[f"__on_{c}" for c in on])


def prefix_join(df: DataFrame, col: str, rules: dict[str, list[str]], name: str) -> DataFrame:
    """Add the rule each code's prefix belongs to, one row per matching rule.

    The rules are split by prefix length, so every join is an equality on a
    substring instead of a nested loop.
    """
    by_length: dict[int, dict[str, list[str]]] = {}
    for label, prefixes in rules.items():
        for p in prefixes:
            by_length.setdefault(len(p), {}).setdefault(p, []).append(label)
    hits = []
    for n, table in sorted(by_length.items()):
        head = F.substring(F.col(col), 1, n)
        for labels in {tuple(v) for v in table.values()}:
            mine = sorted(p for p, v in table.items() if tuple(v) == labels)
            hits += [F.when(head.isin(*mine), F.lit(label)) for label in labels]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(found))


def prefix_join_table(df: DataFrame, col: str, rules: DataFrame, prefix: str, lengths: list[int]) -> DataFrame:
    """The same for a rule table: each code meets its own prefixes of the given lengths."""
    heads = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.col(col), 1, n).alias("p")) for n in lengths])
    probes = df.withColumn("__h", F.explode(heads))
    found = probes.join(
        rules, (F.col("__h.p") == F.col(prefix)) & (F.col("__h.n") == F.length(F.col(prefix)))
    )
    return found.drop("__h", prefix)


def lookup_join(df: DataFrame, on: str, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Add the columns of a lookup table with a unique key.

    No hint: Spark broadcasts the table when its known size allows it.
    """
    return df.join(table, df[on].eqNullSafe(table[key]), how).drop(table[key])


HEAVY_SHARE = 1_000
HEAVY_LEAST = 100_000


def heavy_tuples(df: DataFrame, combos: list[list[str]], share: int = HEAVY_SHARE, least: int = HEAVY_LEAST) -> dict:
    """Per column tuple its value tuples in more than 1/``share`` of all rows (and more than ``least``), if there are any.

    All column tuples are counted in one pass, combined before the shuffle; at most ``share`` tuples each can be
    that frequent, so each table is small whatever the data.
    """
    total = df.count()
    if total <= least:
        return {}
    parts = [F.struct(F.lit(i).alias("i"), F.xxhash64(*cols).alias("h")) for i, cols in enumerate(combos)]
    counted = df.select(F.inline(F.array(*parts))).groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
    # at most ``share`` hashes a combination
    often = counted.where(F.col("n") > max(least, total // share)).select("i", "h").collect()
    out = {}
    for i, cols in enumerate(combos):
        hashes = [r["h"] for r in often if r["i"] == i]
        if hashes:
            hit = df.where(F.xxhash64(*cols).isin(hashes)).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
            out[tuple(cols)] = materialize(hit.where(F.col("__n") > max(least, total // share)).select(*cols))
    return out


def mark_exists(syn: DataFrame, orig: DataFrame, cols: list[str], name: str, heavy: DataFrame | None = None) -> DataFrame:
    """Flag the rows of ``syn`` whose tuple of values occurs in ``orig``.

    Tuples are compared column by column with NULL equal to NULL, and the
    original's tuples are made distinct first, so no row is repeated. Tuples in
    more than a thousandth of the rows (``heavy``, else looked for) are looked
    up once and answered from a small broadcast table where the rows are; only
    the other rows are shuffled, so no task gets the rows of a hot tuple.
    """
    if heavy is None:
        heavy = heavy_tuples(syn, [cols]).get(tuple(cols))
    renamed = {c: f"__{c}" for c in cols}
    seen = orig.select(*[F.col(c).alias(renamed[c]) for c in cols]).distinct()
    pairs = list(renamed.items())
    kept = [syn[c] for c in syn.columns]
    if heavy is None:
        found = seen.withColumn("__hit", F.lit(True))
        joined = syn.join(found, null_safe(syn, found, pairs), "left")
        return joined.select(*kept, F.coalesce(F.col("__hit"), F.lit(False)).alias(name))
    # at most HEAVY_SHARE rows, so the broadcasts are bounded
    few = heavy.select(*[F.col(c).alias(f"__h_{c}") for c in cols])
    asked = [(f"__h_{c}", renamed[c]) for c in cols]
    sought = orig.join(F.broadcast(few), null_safe(orig, few, [(c, f"__h_{c}") for c in cols]), "left_semi")
    sought = sought.select(*[F.col(c).alias(renamed[c]) for c in cols]).distinct().withColumn("__hit", F.lit(True))
    answer = few.join(sought, null_safe(few, sought, asked), "left")
    answer = materialize(answer.select(*few.columns, F.coalesce(F.col("__hit"), F.lit(False)).alias("__answer")))
    on = null_safe(syn, answer, [(c, f"__h_{c}") for c in cols])
    hot = syn.join(F.broadcast(answer), on).select(*kept, F.col("__answer").alias(name))
    rest = syn.join(F.broadcast(answer), on, "left_anti")
    found = seen.withColumn("__hit", F.lit(True))
    cold = rest.join(found, null_safe(rest, found, pairs), "left")
    return hot.unionByName(cold.select(*[rest[c] for c in syn.columns], F.coalesce(F.col("__hit"), F.lit(False)).alias(name)))
