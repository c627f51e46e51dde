"""Report tables: one folder per report, one partition per section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, section: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Add a section to a report; 'overwrite' replaces that section only."""
    out = df.withColumn("section", F.lit(section))
    writer = out.write.partitionBy("section").format(fmt).mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def read_report(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """A report; sections may have different columns."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if section is None else df.filter(F.col("section") == section)
