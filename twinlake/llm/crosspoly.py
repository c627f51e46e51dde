"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the signed axis it is
closest to. A table's code joins several such hashes, from rotations of its own. A vector is stored under its code
and looks into that and, by multiprobe, the codes with the next-closest axes. Vectors that meet are verified with
the exact cosine in double precision, so no link is below the threshold.

Equal vectors are one class: copies are counted, not compared. Cells are cut into blocks (``blocks.py``). A pair may
meet in several cells; it counts only in the first table and cell in which both stand, which both codes tell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .blocks import meeting_pairs, shards, spanning, units
from .common import components, salted_left_join
from .workers import give_back


@dataclass(frozen=True)
class CrossPolytope:
    dim: int
    tables: int = 10
    hashes: int = 2
    probes: int = 3
    seed: int = 11

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, shape (n, tables, 1 + probes): the own code, then the probed ones."""
        width = 1 << max(self.dim - 1, 1).bit_length()
        rng = np.random.default_rng(self.seed)
        signs = rng.choice([-1.0, 1.0], (self.tables, self.hashes, 3, width))
        n = len(vectors)
        padded = np.zeros((n, width))
        padded[:, : vectors.shape[1]] = vectors
        out = np.zeros((n, self.tables, 1 + self.probes), np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            best, gains = [], []
            for h in range(self.hashes):
                x = padded
                for k in range(3):
                    x = hadamard(x * signs[t, h, k])
                size = np.abs(x)
                top = np.argpartition(-size, min(self.probes, width - 1), axis=1)[:, : self.probes + 1]
                order = np.take_along_axis(size, top, 1).argsort(1)[:, ::-1]
                top = np.take_along_axis(top, order, 1)
                best.append(2 * top + (np.take_along_axis(x, top, 1) < 0))
                value = np.take_along_axis(size, top, 1)
                gains.append(value[:, :1] - value)
            base = [b[:, 0] for b in best]
            out[:, t, 0] = self._join(t, base, width)
            # probes replace the axis of one hash by its next ones; those that lose least go first
            loss = np.concatenate([g[:, 1:] for g in gains], 1)
            order = np.argsort(loss, 1, kind="stable")[:, : self.probes]
            per = best[0].shape[1] - 1
            out[:, t, 1:] = -1 - t  # where there are fewer axes than probes: a cell without own codes
            for k in range(order.shape[1]):
                which, rank = order[:, k] // per, order[:, k] % per + 1
                axes = [np.where(which == h, best[h][rows, rank], base[h]) for h in range(self.hashes)]
                out[:, t, 1 + k] = self._join(t, axes, width)
        return out

    def _join(self, table: int, axes: list[np.ndarray], width: int) -> np.ndarray:
        code = np.full(len(axes[0]), table, np.int64)
        for a in axes:
            code = code * (2 * width) + a
        return code


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the rows."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(classes: DataFrame, lsh_of: Callable[[int], CrossPolytope]) -> DataFrame:
    """The cells of each vector; vectors of different lengths never share a cell."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2_000):
                for dim, part in _by_length(pdf.iloc[lo : lo + 2_000]):
                    codes = lsh_of(dim).codes(_unit(_matrix(part["vector"], dim)))
                    n, per = len(part), codes.shape[1] * codes.shape[2]
                    at = np.repeat(np.arange(n), per)
                    yield pd.DataFrame(
                        {
                            "cell": codes.reshape(-1) * 0x10001 + dim,
                            "id": part["id"].to_numpy()[at],
                            "copies": part["copies"].to_numpy()[at],
                            "probe": np.tile(np.arange(codes.shape[2]) > 0, n * codes.shape[1]),
                        }
                    )

    return classes.mapInPandas(run, "cell long, id long, copies long, probe boolean")


def _by_length(pdf: pd.DataFrame):
    sizes = pdf["vector"].map(len) // 8
    for dim in np.unique(sizes):
        yield int(dim), pdf[sizes == dim]


def _first_meeting(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """The first cell in which each pair meets: by table, then the cell of a's own code before that of b's."""
    in_a = (codes_b == codes_a[:, :, :1]).any(2)
    in_b = (codes_a == codes_b[:, :, :1]).any(2)
    table = (in_a | in_b).argmax(1)
    rows = np.arange(len(table))
    return np.where(in_a[rows, table], codes_a[rows, table, 0], codes_b[rows, table, 0])


def verifier(lsh_of: Callable[[int], CrossPolytope], least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [one_length(lsh_of(dim), dim, part) for dim, part in _by_length(pdf)]
        give_back()
        return pd.concat(parts, ignore_index=True)

    def one_length(lsh: CrossPolytope, dim: int, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, cell = (pdf[c].to_numpy() for c in ("id", "copies", "cell"))
        unit = _unit(_matrix(pdf["vector"], dim))
        columns = [pdf[c].to_numpy() for c in ("cell", "lo", "hi", "own", "id", "probe")]
        nodes, counts, edges_a, edges_b = [], [], [], []
        for i, j in meeting_pairs(*columns, most=200_000):
            close = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            i, j = i[close], j[close]
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for lo in range(0, len(i), 20_000):
                a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
                used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                codes = lsh.codes(unit[used])
                first = _first_meeting(codes[back[: len(a)]], codes[back[len(a) :]])
                # the rows of a pair may stand here twice, as own code and as probe, but own codes are unique
                once = first * 0x10001 + dim == cell[a]
                a, b = a[once], b[once]
                nodes += [ids[a], ids[b]]
                counts += [copies[b], copies[a]]
                x, y = spanning(ids[a], ids[b])
                edges_a.append(x)
                edges_b.append(y)
        if not nodes:
            return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        own = pd.DataFrame({"id": np.concatenate(nodes), "links": np.concatenate(counts)}).groupby("id", as_index=False)["links"].sum()
        x, y = spanning(np.concatenate(edges_a), np.concatenate(edges_b))
        own["other"] = own["id"]
        more = pd.DataFrame({"id": x, "links": np.zeros(len(x), np.int64), "other": y})
        return pd.concat([own, more], ignore_index=True)

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, lsh: CrossPolytope | None = None
) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept.

    Links join rows whose vectors have a cosine of ``least`` or more. Vectors that are NULL, empty, zero or hold NULL
    or non-finite components have no link and are components of their own; vectors of different lengths are never
    linked. ``lsh`` sets tables, hashes, probes and seed for every length. component_id is the smallest id reachable. Rows that share
    id and vector are linked copies. Other columns are ignored.
    """
    vector = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        vector, lambda v: v != 0
    )
    base = rows.select(F.col(id_col).alias("__id"), F.when(F.coalesce(sound, F.lit(False)), vector).alias("__v"))
    how = lsh or CrossPolytope(1)

    def lsh_of(dim: int) -> CrossPolytope:
        return replace(how, dim=dim)

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (np.asarray(x, "<f8") + 0.0).tobytes() for x in v])

    base = base.withColumn("__b", packed("__v")).drop("__v")
    base = materialize(base.withColumns({"__class": F.xxhash64("__b"), "__row": F.monotonically_increasing_id()}))
    classes = (
        base.where("__b IS NOT NULL")
        .groupBy("__class", "__b")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("__id").alias("low"))
        .select(F.col("__class").alias("id"), "copies", "low", F.col("__b").alias("vector"))
    )
    classes = materialize(classes)
    codes = materialize(hashed(classes, lsh_of))
    # only cells in which two vectors meet, at least one by its own code, get the vectors themselves
    shared = codes.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"), F.bool_or(~F.col("probe")).alias("__own")).where("__n > 1 AND __own")
    live = salted_left_join(codes, materialize(shared.select("cell", F.lit(True).alias("__live"))), "cell", F.col("id"))
    cut = materialize(units(live.where("__live").drop("__live"), 512))
    met = cut.join(classes.select("id", "vector"), "id")
    met = shards(met, cut.count(), 60_000)
    found = materialize(met.groupBy("shard").applyInPandas(verifier(lsh_of, least), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.select("id", "copies", "low").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    lows = known.groupBy("root").agg(F.min("low").alias("least"))
    known = known.join(lows, "root").join(links, "id", "left")
    known = materialize(known.select(F.col("id").alias("__class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "least"))
    linked = salted_left_join(base.where("__b IS NOT NULL").drop("__b"), known, "__class", F.col("__row"))
    linked = linked.select("__id", "n", "least")
    alone = base.where("__b IS NULL").select("__id", F.lit(0).cast("long").alias("n"), F.col("__id").alias("least"))
    return linked.unionByName(alone).select(
        F.col("__id").alias(id_col), F.col("n").alias("n_links"), F.col("least").alias("component_id"), F.col("__id").eqNullSafe(F.col("least")).alias("kept")
    )
