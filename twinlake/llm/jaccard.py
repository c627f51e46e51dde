"""Near duplicates by the Jaccard similarity of word shingles, found by SimHash and MinHash and checked exactly.

A text is the set of 64-bit hashes of its shingles. Its SimHash fingerprint is looked up in the grid of two-bit
popcounts (``simhash.py``); texts whose fingerprints are linked, within three bits each, stand in one cell. A pair of
similarity 0.8 has fingerprints some ten bits apart, out of reach of any grid that can be afforded, so ``BANDS`` bands
of ``DEPTH`` minimum hashes each are more cells for the same text: a pair of similarity 0.8 shares one of those with
probability 0.9993, one of 0.85 with more than 0.99999.
Texts that share a cell are first compared with the cell's smallest row, which settles a group of near copies with
one comparison a member. Cells whose members are not all linked after that are compared pair by pair, in blocks
(``blocks.py``). Only pairs whose sets have the asked similarity are linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.scratch import materialize, scope

from .blocks import meeting_pairs, shards, units
from .common import bits_for, components, key_bits, located, salted_left_join, with_bit
from .simhash import WORD, linked as near_prints, majority
from .workers import TEXT_BATCH, batches_of, give_back, kept

BANDS, DEPTH = 40, 8
#: Bytes of shingle sets that go to one task when cells are compared pair by pair.
SHARD_BYTES = 8_000_000
#: Members of a cell's smallest row that one task compares with it.
STAR = 1_000


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one shingle, one without words too."""
    import xxhash

    words, h = WORD.findall((text or "").encode().lower()), xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    last = (ends[size - 1 :] - 1).tolist()
    return np.unique(np.array([h(line[a:b], seed) for a, b in zip(first, last)], np.uint64))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32))


MULTIPLY, FLIP = _mixers()


def cells(found: np.ndarray) -> np.ndarray:
    """The cells of a shingle set, one a band."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        mixed = (low[None, k : k + 512] ^ FLIP) * MULTIPLY
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(1), out=least)
    cell = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in least.reshape(BANDS, DEPTH).T:
        cell = (cell ^ part) * np.uint64(0xD6E8FEB86659FD93)
        cell ^= cell >> np.uint64(32)
    return cell.view(np.int64)


def _cells(size: int):
    @F.pandas_udf("print long, cells array<long>")
    def run(text: pd.Series) -> pd.DataFrame:
        kept("near")  # what earlier stages left in the worker goes
        prints, found = np.zeros(len(text), np.uint64), []
        for k, t in enumerate(text):
            mine = shingles(t, size)
            prints[k] = majority(mine)
            found.append(cells(mine))
        out = pd.DataFrame({"print": prints.view(np.int64), "cells": pd.Series(found, dtype=object)})
        give_back()
        return out

    return run


def _sets(size: int):
    @F.pandas_udf(T.BinaryType())
    def run(text: pd.Series) -> pd.Series:
        out = pd.Series([shingles(t, size).tobytes() for t in text], dtype=object)
        give_back()
        return out

    return run


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def _alike(least: float):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(a, b)], dtype=bool)

    return run


def _pairs(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ident, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["found"]]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        columns = [pdf[c].to_numpy() for c in ("cell", "lo", "hi", "own")]
        a, b, seen = [], [], set()
        for i, j in meeting_pairs(*columns, ident, np.zeros(len(pdf), bool), most=100_000):
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = root(comp[x]), root(comp[y])
                pair = (min(ident[x], ident[y]), max(ident[x], ident[y]))
                if p != q and pair not in seen:
                    seen.add(pair)
                    if alike(sets[x], sets[y], least):
                        up[max(p, q)] = min(p, q)
                        a.append(pair[0])
                        b.append(pair[1])
        give_back()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), size: int = 5, least: float = 0.8
) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, component_id, kept.

    Texts whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more are linked; words are
    runs of other than blanks, A-Z lower-cased, and a text of fewer words is one shingle. component_id is the
    smallest id reachable, NULL only if all ids are; ``kept`` is true for one row of each component (smallest id, then
    row number). NULL, empty and blank texts are alike. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with scope(spark) as own, batches_of(spark, TEXT_BATCH):
        return own.keep(_near_texts(docs, id_col, text_col, carry, size, least))


def _near_texts(docs, id_col, text_col, carry, size, least) -> DataFrame:
    carried = [f"__c_{i}" for i in range(len(carry))]
    rows = located(docs, "__place").select(
        "__place", F.col(id_col).alias("__id"), *[F.col(c).alias(n) for c, n in zip(carry, carried)], F.col(text_col).alias("__text")
    )
    # the texts themselves are never written: a row number goes with each row's place in its file
    slim = rows.withColumns({"id": F.monotonically_increasing_id(), "__at": _cells(size)("__text")}).drop("__text")
    slim = materialize(slim.select("*", "__at.print", "__at.cells").drop("__at"))
    # linked fingerprints are one cell, minimum hashes give more
    prints = materialize(slim.select(F.col("print").alias("id")).distinct())
    group = materialize(near_prints(prints).select(F.col("node").alias("print"), "root"))
    printed = salted_left_join(slim.select("id", "print"), group, "print", F.col("id"))
    printed = printed.select("id", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("cell"))
    bands = slim.select("id", F.explode("cells").alias("cell")).unionByName(printed)
    heads = bands.groupBy("cell").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = materialize(heads.select("cell", "head"))
    members = materialize(salted_left_join(bands, heads, "cell", F.col("id")).where("head IS NOT NULL"))

    # the shingles of texts that share a cell, once
    met = materialize(members.select("id").distinct())
    met = materialize(slim.select("id", "__place").join(met, "id", "left_semi"))
    bits = bits_for(met.count())
    key = F.xxhash64("__place")
    marked = with_bit(rows.select("__place", "__text"), key, key_bits(met.select(key.alias("__k")), "__k", bits), bits, "__in")
    sets = marked.where("__in").select("__place", _sets(size)("__text").alias("found"))
    sets = materialize(sets.join(met, "__place").select("id", "found"))

    stars = materialize(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    copies = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("__parts"))
    copies = materialize(copies)
    part = F.pmod(F.xxhash64("b"), F.col("__parts")).cast("int")
    asked = salted_left_join(stars, copies, "a", F.col("b")).select("a", "b", part.alias("part"))
    asked = asked.join(sets.select(F.col("id").alias("b"), F.col("found").alias("__y")), "b")
    leaders = copies.join(sets.select(F.col("id").alias("a"), F.col("found").alias("__x")), "a")
    leaders = leaders.select("a", "__x", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"))
    both = asked.join(leaders.hint("merge"), ["a", "part"])
    linked = materialize(both.where(_alike(least)("__x", "__y")).select("a", "b"))

    roots = materialize(components(linked))
    placed = salted_left_join(members.select("cell", "id"), roots.withColumnRenamed("node", "id"), "id", F.col("cell"))
    placed = materialize(placed.select("cell", "id", F.coalesce("root", "id").alias("comp")))
    mark = F.xxhash64("id")
    kinds = placed.groupBy("cell").agg(
        F.min("comp").alias("__low"),
        F.max("comp").alias("__high"),
        F.struct(F.count(F.lit(1)), F.min("id"), F.max("id"), F.bit_xor(mark), F.bit_xor(F.xxhash64(mark))).alias("__who"),
    )
    # the same members meet in many cells: one of those is enough
    mixed = kinds.where("__low < __high").groupBy("__who").agg(F.min("cell").alias("cell"))
    mixed = materialize(mixed.select("cell", F.lit(True).alias("__mixed")))
    left = salted_left_join(placed, mixed, "cell", F.col("id")).where("__mixed").select("cell", "id", "comp")
    cut = materialize(units(left, block=128).join(sets, "id"))
    total = cut.agg(F.sum(F.length("found")).alias("n")).first()["n"] or 0
    more = shards(cut, total, SHARD_BYTES).groupBy("shard").applyInPandas(_pairs(least), "a long, b long")
    links = materialize(linked.unionByName(more))

    roots = components(links)
    known = slim.drop("cells", "print", "__place").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(known.withColumn("__root", F.coalesce("root", "id")).drop("root"))
    # NULL ids sort last, as in min()
    smallest = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("id").alias("row")))
    best = materialize(known.groupBy("__root").agg(smallest.alias("__best")))
    out = salted_left_join(known, best, "__root", F.col("id"))
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(n).alias(c) for c, n in zip(carry, carried)],
        F.col("__best.id").alias("component_id"),
        (F.col("id") == F.col("__best.row")).alias("kept"),
    )
