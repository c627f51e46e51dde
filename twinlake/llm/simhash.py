"""Near duplicates by SimHash, joined through a segment-popcount embedding.

The 64 bits of a fingerprint are cut into 32 segments of two bits, and the fingerprint is mapped to the vector of
its segments' bit counts. The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. Fingerprints within 3 bits therefore have one half (16 segments) of their vectors within Manhattan
distance 1: each half is a cell of a grid, a fingerprint stands in the cell of each half and looks into the cells
one step up along every axis, and two fingerprints within range meet in the lower one's view of the upper one's
cell. Candidates pass the Manhattan bound and are then verified on the bits.

All of it runs on distinct fingerprints, so copies cost nothing; a full cell is cut into blocks (``blocks.py``).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.scratch import materialize

from .blocks import meeting_pairs, shards, spanning, units
from .common import components, salted_left_join
from .workers import give_back

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)
PAIRS = 0x5555555555555555


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text; 0 without words."""
    import xxhash

    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line, h = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate([[0], ends[: len(words) - size]]).tolist()
        last = (ends[size - 1 :] - 1).tolist()
        hashes = [h(line[a:b], seed) for a, b in zip(first, last)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    raw = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    prints = pd.Series([fingerprint(t) for t in text], dtype="uint64").astype("int64")
    give_back()
    return prints


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The 32 two-bit counts of each fingerprint, still packed two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(PAIRS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed two-bit counts."""
    out = np.zeros(len(a), np.int64)
    for shift in range(0, 64, 2):
        x, y = (a >> np.uint64(shift)) & np.uint64(3), (b >> np.uint64(shift)) & np.uint64(3)
        out += np.abs(x.astype(np.int64) - y.astype(np.int64))
    return out


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    fp = pdf["id"].to_numpy().view(np.uint64)
    counts = popcounts(fp)
    found_a, found_b = [], []
    columns = [pdf[c].to_numpy() for c in ("cell", "lo", "hi", "own", "id", "probe")]
    for i, j in meeting_pairs(*columns, most=200_000):
        close = manhattan(counts[i], counts[j]) <= 3
        i, j = i[close], j[close]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= 3
        a, b = spanning(pdf["id"].to_numpy()[i[ok]], pdf["id"].to_numpy()[j[ok]])
        found_a.append(a)
        found_b.append(b)
    give_back()
    if not found_a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
    return pd.DataFrame({"a": a, "b": b})


def grid(prints: DataFrame) -> DataFrame:
    """(cell, id, probe) of distinct fingerprints ``id``: own cell and the cells one step up, for both halves."""
    halves = prints.selectExpr(
        "id",
        "explode(array(struct(0L AS half, id & 4294967295L AS bits), "
        "struct(1L AS half, shiftrightunsigned(id, 32) AS bits))) AS h",
    ).selectExpr("id", "h.half AS half", f"h.bits - (shiftrightunsigned(h.bits, 1) & {PAIRS & 0xFFFFFFFF}L) AS at")
    steps = ", ".join(
        f"IF((shiftrightunsigned(at, {2 * i}) & 3) < 2, at + {1 << (2 * i)}L, NULL)" for i in range(16)
    )
    looks = halves.selectExpr("id", "half", "at", f"posexplode(array(at, {steps})) AS (pos, seen)").where("seen IS NOT NULL")
    return looks.selectExpr("seen * 2 + half AS cell", "id", "pos > 0 AS probe")


def linked(prints: DataFrame) -> DataFrame:
    """(node, root) of the distinct fingerprints ``id`` (a written table) that differ from another in at most three bits.

    root is the smallest fingerprint, as a signed number, that is reachable.
    """
    cells = grid(prints.select("id"))
    near = shards(units(cells), 30 * prints.count(), 100_000).groupBy("shard").applyInPandas(_near, "a long, b long")
    return components(near)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, fingerprint (16 hex digits), component_id, kept.

    Fingerprints that differ in at most three bits are linked; component_id is the smallest id reachable, NULL only
    if all ids are; ``kept`` is true for one row of each component (smallest id, then row number). NULL, empty and
    blank texts have fingerprint zero and are linked like any other. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        *[F.col(c).alias(f"__c_{i}") for i, c in enumerate(carry)],
        fingerprints(F.col(text_col)).alias("__fp"),
    )
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    # NULL ids sort last, as in min()
    smallest = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    prints = materialize(rows.groupBy(F.col("__fp").alias("id")).agg(smallest.alias("first")))
    roots = linked(prints)
    known = prints.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("__fp"), F.coalesce("root", "id").alias("__root"), "first"
    )
    best = known.groupBy("__root").agg(F.min("first").alias("__best"))
    known = materialize(known.join(best, "__root").select("__fp", "__best"))
    out = salted_left_join(rows, known, "__fp", F.col("__row"))
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__c_{i}").alias(c) for i, c in enumerate(carry)],
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__best.id").alias("component_id"),
        (F.col("__row") == F.col("__best.row")).alias("kept"),
    )
