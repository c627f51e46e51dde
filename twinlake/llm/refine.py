"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after lower-casing A-Z; NULL counts as the empty text. Each level is one
narrow aggregate (counts per key, combined before the shuffle); the keys that occur more than once are kept as a
bit set of bounded size, which decides for every row of the next scan whether it goes on. A text whose length or
prefix is unique is never hashed in full and the text itself is never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.scratch import materialize

from .common import LOWER, UPPER, key_bits, salted_left_join, with_bit


def _digests(batches):
    for batch in batches:
        names = batch.schema.names
        text = pc.ascii_lower(batch.column(names.index("__text")))
        sha = pa.array([hashlib.sha256(t.as_buffer()).digest() if t.is_valid else None for t in text], pa.binary())
        rest = [n for n in names if n != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [sha], names=[*rest, "__sha"])


def repeated(rows: DataFrame, key: str, bits: int) -> DataFrame:
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return key_bits(again, key, bits)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix_chars: int = 64,
    bits: int = 22,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; of rows that also share the id, one. A NULL id is smaller
    than any other. ``digest_all`` fills text_sha256 for texts known to be unique too (else NULL for those).
    An empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c_{i}") for i, c in enumerate(carry)], text.alias("__text")
    )
    length = F.octet_length("__text")
    by_length = F.xxhash64(length)
    head = F.translate(F.substring("__text", 1, prefix_chars), UPPER, LOWER)
    by_prefix = F.xxhash64(length, head)

    lengths = repeated(rows.select(by_length.alias("__k")), "__k", bits)
    level1 = with_bit(rows, by_length, lengths, bits, "__in1")
    prefixes = repeated(level1.where("__in1").select(by_prefix.alias("__k")), "__k", bits)
    level2 = with_bit(level1, F.when(F.col("__in1"), by_prefix), prefixes, bits, "__in2")

    level2 = level2.drop("__in1").withColumn("__row", F.monotonically_increasing_id())
    if not digest_all:
        level2 = level2.withColumn("__text", F.when(F.col("__in2"), F.col("__text")))
    schema = T.StructType([f for f in level2.schema if f.name != "__text"] + [T.StructField("__sha", T.BinaryType())])
    hashed = materialize(level2.mapInArrow(_digests, schema))

    groups = (
        hashed.where("__in2")
        .groupBy("__sha")
        .agg(F.max(F.struct("__id", "__row")).alias("__keep"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
    )
    out = salted_left_join(hashed, materialize(groups), "__sha", F.col("__row"))
    alone = F.col("__n").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__c_{i}").alias(c) for i, c in enumerate(carry)],
        F.when(alone, F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__row") == F.col("__keep.__row"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
