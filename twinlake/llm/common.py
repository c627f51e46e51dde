"""Shared pieces: row numbers, bounded key sets, salted joins and connected components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize, scope

SALTS = 16
SMALL = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a number per row, written once so that the numbers stay."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def located(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a key per row that is the same in every scan: its file and its place in it.

    Nothing is written if ``df`` reads Parquet files without joins or groupings; other frames are written first.
    """
    if _scans_files(df):
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return df.select("*", at.alias(name))
    at = F.struct(F.lit("").alias("file"), F.col(name).alias("at"))
    return numbered(df, name).withColumn(name, at)


def _scans_files(df: DataFrame) -> bool:
    """Whether ``df`` is columns and rows picked from Parquet files, each row at most once."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    try:
        return node.nodeName() == "LogicalRelation" and bool(df.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def bits_for(rows: int) -> int:
    """Bits (as a power of two) of a set in which few of ``rows`` keys meet; bounded, so that it can be broadcast."""
    return min(25, max(16, (16 * rows).bit_length()))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (a written table of keys, each in one row of ``rows`` at most).

    A bit set of bounded size lets most rows pass where they are; only rows whose bit is set are shuffled.
    """
    bits = bits_for(gone.count())
    table = key_bits(gone.select(F.xxhash64(key).alias("__k")), "__k", bits)
    marked = with_bit(rows, F.xxhash64(key), table, bits, "__in")
    maybe = marked.where("__in").drop("__in").join(gone.select(key), key, "left_anti")
    return marked.where("NOT __in").drop("__in").unionByName(maybe)


def within(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` (a written table of keys); rows whose bit is not set are not shuffled."""
    bits = bits_for(wanted.count())
    table = key_bits(wanted.select(F.xxhash64(key).alias("__k")), "__k", bits)
    marked = with_bit(rows, F.xxhash64(key), table, bits, "__in")
    return marked.where("__in").drop("__in").join(wanted.select(key), key, "left_semi")


def key_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The 64-bit hashes in ``key`` as a bit set: at most 2^(bits-6) rows (word, mask), however many keys there are.

    A bit that is not set proves that a key is absent; a set bit proves nothing.
    """
    return materialize(
        keys.groupBy(_word(F.col(key), bits).alias("__word")).agg(
            F.expr(f"bit_or(shiftleft(1L, CAST({key} & 63 AS INT)))").alias("__mask")
        )
    )


def _word(key: Column, bits: int) -> Column:
    return F.shiftright(key, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))


def with_bit(df: DataFrame, key: Column, bit_table: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with the boolean column ``flag``: whether the bit of ``key`` is set. The bit table is broadcast: its size is bounded."""
    probed = df.withColumns({"__key": key}).withColumn("__word", _word(F.col("__key"), bits))
    hit = F.expr("shiftrightunsigned(__mask, CAST(__key & 63 AS INT)) & 1 = 1")
    return (
        probed.join(F.broadcast(bit_table), "__word", "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("__key", "__word", "__mask")
    )


def salted_left_join(rows: DataFrame, facts: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``facts`` (a written table, one row per key).

    A table of at most SMALL rows is broadcast; for a longer one, the rows of one key go to SALTS tasks.
    """
    if facts.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [key, "__salt"], "left").drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long): the smallest node it is connected to.

    Each round hangs every node on its smallest neighbour, follows the pointers to their roots and contracts
    the edges, so the number of rounds grows with the logarithm of the longest chain. Nothing is collected
    but counts; each round's tables are written to the shared folder and deleted at the end.
    """
    with scope(edges.sparkSession) as own:
        return own.keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    left = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    labels = materialize(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().selectExpr("node", "node AS root"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b"))
        step = materialize(step.select(F.col("a").alias("__n"), F.least("a", "b").alias("__p")))
        while True:
            up = step.select(F.col("__n").alias("__m"), F.col("__p").alias("__q"))
            jumped = step.join(up, F.col("__p") == F.col("__m"), "left").select(
                "__n", F.coalesce("__q", "__p").alias("__p"), (F.coalesce("__q", "__p") != F.col("__p")).alias("__moved")
            )
            jumped = materialize(jumped)
            step = jumped.select("__n", "__p")
            if jumped.where("__moved").isEmpty():
                break
        labels = materialize(
            labels.join(step, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__p", "root").alias("root"))
        )
        a = left.join(step, F.col("a") == F.col("__n")).select(F.col("__p").alias("a"), "b")
        b = a.join(step, F.col("b") == F.col("__n")).select("a", F.col("__p").alias("b"))
        left = materialize(b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    return labels
