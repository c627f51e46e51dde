"""Small intermediate tables in the folder the cluster shares.

An operator that uses one aggregate twice writes it once, so a lost executor
re-reads files instead of re-running the scan, and Spark knows the size of the
table when it chooses between a broadcast and a shuffle join.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="twinlake-"))
    return f"{base.rstrip('/')}/twinlake-{app}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    scopes = getattr(_open, "scopes", [])
    if scopes:
        scopes[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """The tables written since ``scope`` was entered."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a table of the surrounding scope: it stays when this one ends."""
        mine = _open.scopes.pop()
        try:
            return materialize(df)
        finally:
            _open.scopes.append(mine)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables that are written inside are deleted at the end; what is needed later goes through ``keep``.

    Frames that read a deleted table can no longer be run, so nothing but kept tables may leave the scope. Scopes
    nest, and a thread has its own.
    """
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    mine = Scope(spark)
    _open.scopes.append(mine)
    try:
        yield mine
    finally:
        _open.scopes.remove(mine)
        drop(spark, mine.paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, on whatever file system they are."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)
