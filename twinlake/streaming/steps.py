"""Row-wise steps and leak checks on streams.

The column expressions of this library are the same for batch and stream. Steps
that count groups need the whole table and are rejected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.operators.joins import null_safe
from twinlake.plans.recipe import SEEDED, STEPS

WHOLE_TABLE = {"suppress_small_groups", "suppress_min_distinct"}


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).options(**options).parquet(folder)


def apply_steps(stream: DataFrame, steps: list[dict], seed) -> DataFrame:
    """Apply recipe steps that need one row at a time; pseudonyms must use the hash method."""
    for step in steps:
        args = dict(step)
        op = args.pop("op")
        if op in WHOLE_TABLE or (op == "pseudonymize" and args.get("method") != "hash"):
            raise ValueError(f"step {op!r} needs the whole table")
        stream = SEEDED[op](stream, seed, **args) if op in SEEDED else STEPS[op](stream, **args)
    return stream


def leak_flags(stream: DataFrame, orig: DataFrame, cols: list[str], name: str = "in_original") -> DataFrame:
    """Flag streamed rows whose tuple occurs in a static original (stream-static left join)."""
    seen = orig.select(*[F.col(c).alias(f"__{c}") for c in cols]).distinct().withColumn("__hit", F.lit(True))
    joined = stream.join(seen, null_safe(stream, seen, [(c, f"__{c}") for c in cols]), "left")
    return joined.select(*stream.columns, F.coalesce("__hit", F.lit(False)).alias(name))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there into Parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
