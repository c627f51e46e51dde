"""What a Python worker keeps between tasks, and what it gives back."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For jobs that hand whole texts, or sets as long, to Python.
TEXT_BATCH = 4 << 20


def kept(owner: str) -> dict:
    """A dictionary that lives as long as the worker process; for tables and caches that any task can rebuild.

    Workers live on from stage to stage, so what another operator (``owner``) left in it is given back first.
    """
    held = sys.modules.setdefault("_twinlake_llm_kept", types.ModuleType("_twinlake_llm_kept"))
    if getattr(held, "owner", owner) != owner:
        held.cache.clear()
        give_back()
    held.owner = owner
    if not hasattr(held, "cache"):
        held.cache = {}
    return held.cache


def give_back() -> None:
    """Return freed memory to the system: idle workers stay alive beside the next stage's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of about ``most`` bytes; a smaller limit of the session stays.

    A task holds some batches in the executor and in its worker at once, and rows of long texts make them large.
    """
    before = spark.conf.get(BATCH_BYTES)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(BATCH_BYTES, str(min(most, limit) if limit > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)
