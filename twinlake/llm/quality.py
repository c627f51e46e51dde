"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network over how its characters and character
classes follow each other; a gated attention net, learned from document labels alone, weights the passages, and the
weighted representation is scored. Training uses a bounded sample of labelled documents; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import give_back

PASSAGE = 400
CLASSES = 12
N_FEATURES = 128 + CLASSES * CLASSES + 3


def _class_table() -> np.ndarray:
    """Class of a byte: blank, line end, lower, upper, digit, stop, mark, quote, bracket, symbol, pipe, beyond ASCII."""
    table = np.full(256, 9, np.uint8)
    for k, chars in enumerate((" \t", "\n\r")):
        table[[ord(c) for c in chars]] = k
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    for k, chars in ((5, ".,;:"), (6, "!?"), (7, "\"'`"), (8, "()[]{}<>"), (10, "|")):
        table[[ord(c) for c in chars]] = k
    table[128:] = 11
    return table


CLASS = _class_table()


def passage_lengths(raw: np.ndarray) -> np.ndarray:
    """Lengths of the passages of one text: lines, cut every PASSAGE bytes; an empty text is one empty passage."""
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    ends = np.append(np.flatnonzero(raw == 10) + 1, n)
    ends = ends[np.diff(ends, prepend=0) > 0]
    sizes = np.diff(ends, prepend=0)
    parts = -(-sizes // PASSAGE)
    out = np.full(int(parts.sum()), PASSAGE, np.int64)
    out[np.cumsum(parts) - 1] = sizes - (parts - 1) * PASSAGE
    return out


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of passages of each text."""
    raws = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    lengths = [passage_lengths(r) for r in raws]
    counts = np.array([len(x) for x in lengths])
    sizes = np.concatenate(lengths)
    data = np.concatenate(raws) if raws else np.zeros(0, np.uint8)
    at = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    kind = CLASS[data]
    low = np.minimum(data, 127).astype(np.int64)
    n = len(sizes)
    chars = np.bincount(at * 128 + low, minlength=n * 128).reshape(n, 128)
    step = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    within = at[:-1] == at[1:]
    key = (at[:-1] * (CLASSES * CLASSES) + step)[within]
    steps = np.bincount(key, minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    scale = 1.0 / np.maximum(sizes, 1)[:, None]
    words = 1 + ((kind[1:] <= 1) & (kind[:-1] > 1) & within).astype(np.int64)
    n_words = np.bincount(at[:-1], words - 1, minlength=n) if len(data) else np.zeros(n)
    extra = np.stack([np.log1p(sizes) / 6, sizes / (1 + n_words) / 10, (sizes == 0)], 1)
    x = np.concatenate([np.sqrt(chars * scale), np.sqrt(steps * scale), extra], 1)
    return x.astype(np.float32), counts


def portions(texts, most: int = 500_000):
    """(index of the first, texts) in parts of about ``most`` characters."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t or "") + 50
        if size > most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


@dataclass
class AttentionModel:
    """Gated attention: a = softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x, counts):
        p = self.params
        starts = np.cumsum(counts) - counts
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["bw"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return x, h, t, g, a, z, s, starts

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, part in portions(texts):
            out[first : first + len(part)] = self.forward(*encode(part))[6]
        give_back()
        return out


def train(texts, labels, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 128, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of document labels, both classes weighted alike; the same input gives the same model."""
    parts = [encode(part) for _, part in portions(texts)]
    x, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    y = np.asarray(labels, np.float32)
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": draw(N_FEATURES, hidden), "bw": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate)}
    p |= {"w": draw(gate), "c": draw(hidden), "b": np.zeros((), np.float32)}
    model = AttentionModel(x.mean(0), (1 / (x.std(0) + 0.02)).astype(np.float32), p)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m, v, step = {k: 0 for k in p}, {k: 0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        for lo in range(0, len(y), batch):
            pick = np.sort(order[lo : lo + batch])
            rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in pick])
            n = counts[pick]
            xb, h, t, g, a, z, s, _ = model.forward(x[rows], n)
            ds = ((s - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dz = ds[:, None] * p["c"]
            dzr = np.repeat(dz, n, axis=0)
            da = (dzr * h).sum(1)
            mid = np.repeat(np.add.reduceat(a * da, np.cumsum(n) - n), n)
            de = a * (da - mid)
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"W": xb.T @ dh, "bw": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "b": ds.sum()}
            step += 1
            for k, d in grads.items():
                d = d + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def neutral(hidden: int = 32, gate: int = 16) -> AttentionModel:
    """A model that has learned nothing: every text scores 0.5."""
    shapes = {"W": (N_FEATURES, hidden), "bw": hidden, "V": (hidden, gate), "U": (hidden, gate), "w": gate, "c": hidden, "b": ()}
    params = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    return AttentionModel(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), params)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = 4_000, sample_bytes: int = 16 << 20
) -> AttentionModel:
    """Train on at most ``sample`` labelled documents (the smallest hashes of their ids) of at most ``sample_bytes``.

    Without any labelled document that fits every text scores 0.5. A text that would exceed ``sample_bytes`` is passed
    over; of rows that share an id the shortest text is learned. Rows without label are ignored; of repeated labels the largest counts. Labels of one class only are accepted.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # at most ``sample`` rows
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).join(F.broadcast(chosen), "__id")
    # of rows that share an id the shortest text counts, so the driver gets one row an id
    text = F.struct(F.octet_length("__t").cast("long").alias("n"), F.xxhash64("__t").alias("h"))
    sizes = rows.groupBy("__id", "__y").agg(F.min(text).alias("w")).select("__id", "__y", "w.n", "w.h", F.xxhash64("__id", F.lit(1)).alias("__o"))
    kept, used = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["__o"], r["__id"])):
        if used + r["n"] <= sample_bytes:  # a text that does not fit is passed over
            kept.append((r["__id"], r["h"]))
            used += r["n"]
    if not kept:
        return neutral()
    wanted = docs.sparkSession.createDataFrame(kept, T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("__h", T.LongType())]))
    data = rows.withColumn("__h", F.xxhash64("__t")).join(F.broadcast(wanted), ["__id", "__h"]).dropDuplicates(["__id"])
    data = data.withColumn("__o", F.xxhash64("__id", F.lit(1))).toPandas().sort_values(["__o", "__id"])
    return train(list(data["__t"]), data["__y"].to_numpy())


def scored(docs: DataFrame, model: AttentionModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1; NULL counts as empty, and empty texts are scored).

    A column that is called like ``out`` is replaced.
    """
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(text)))

    return docs.withColumn(out, score(F.col(text_col)))
