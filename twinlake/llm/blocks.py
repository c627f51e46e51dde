"""Verify candidate pairs that share a cell, in blocks of bounded size.

Rows (cell, id, probe, payload) meet when they share a cell and at least one is not a probe. A cell with more
than ``block`` rows is cut into blocks and every pair of blocks becomes a unit of its own, so no task ever holds
more than two blocks of a cell and no pair is lost. Units are hashed to shards, and inside a shard the sorted rows
are compared at shift 1, 2, 3, ... with numpy, so candidate pairs are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .common import salted_left_join


def units(rows: DataFrame, block: int = 1024) -> DataFrame:
    """``rows`` with (lo, hi, own): the pair of blocks a copy of the row is for, and the block the row is in."""
    heavy = (
        rows.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > block)
        .select("cell", F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    )
    heavy = materialize(heavy)
    cut = salted_left_join(rows, heavy, "cell", F.col("id")).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("__blocks")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.expr("sequence(0, __blocks - 1)")))
    return cut.withColumns({"lo": F.least("own", "__other"), "hi": F.greatest("own", "__other")}).drop("__blocks", "__other")


def shards(rows: DataFrame, n_rows: int, per_shard: int) -> DataFrame:
    n = max(1, -(-n_rows // per_shard))
    return rows.withColumn("shard", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(n)).cast("int"))


def meeting_pairs(cell, lo, hi, own, ident, probe, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows that meet, some at a time."""
    order = np.lexsort((own, hi, lo, cell))
    c, l, h, o, p, d = cell[order], lo[order], hi[order], own[order], probe[order], ident[order]
    new = np.empty(len(c), bool)
    if not len(c):
        return
    new[0] = True
    new[1:] = (c[1:] != c[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(c))
    end = np.repeat(ends, ends - starts)
    at = np.flatnonzero(end - np.arange(len(c)) > 1)
    shift, parts, held = 1, [], 0
    while len(at):
        i, j = at, at + shift
        ok = ~(p[i] & p[j]) & (d[i] != d[j]) & ((l[i] == h[i]) | (o[i] != o[j]))
        i, j = order[i[ok]], order[j[ok]]
        parts.append((i, j))
        held += len(i)
        if held >= most:
            yield np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            parts, held = [], 0
        shift += 1
        at = at[end[at] - at > shift]
    if held:
        yield np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the edges a-b connect."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        while True:
            up = nxt[nxt]
            if np.array_equal(up, nxt):
                break
            nxt = up
        if np.array_equal(nxt, root):
            break
        root = nxt
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]
