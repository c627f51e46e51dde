"""Long repeats by a run-length compressed index.

A window is ``length`` bytes of one document. Every window has an anchor: the smallest hash of its ``gram``-byte
substrings. Equal windows have equal anchors, so texts are cut into runs of windows with one anchor, and only runs
whose anchor stands at two places or more can hold a repeat. Runs with equal bytes are counted, not indexed again;
what is left meets by anchor, in shards of bounded size, where a run-length index decides exactly:

* the runs of a shard are sorted into a suffix array, and their Burrows-Wheeler transform is compressed into runs of
  equal characters, keeping a sample (position, and length of the match with the suffix next to it) at either end of
  a run. In repetitive text there are far fewer runs than bytes;
* inside a BWT run the match of a position is that of the position before it less one, so one streaming pass over the
  text spreads the samples into the matching statistics of every position: its longest match anywhere else;
* windows whose match is ``length`` bytes or more are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .common import salted_left_join
from .workers import kept

#: Bytes of the runs of one anchor beyond which it is cut again by a longer gram.
BUSY_BYTES = 8_000_000
SHARD_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


def _tables(n: int):
    """Random byte values and powers of the multiplier and its inverse, up to n."""
    cache = kept("repeats")
    got = cache.get("repeat_powers")
    if got is None or len(got[1]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        got = values, np.cumprod(up), np.cumprod(down)
        if size <= 1 << 21:
            cache["repeat_powers"] = got
    return got


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    values, up, down = _tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over every ``width`` values in a row."""
    pad = -len(x) % width
    grid = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(grid, 1).ravel()
    behind = op.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, length: int, gram: int):
    """(start, windows, anchor, twice): runs of windows with one anchor; ``twice``: it stands more than once here."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.astype(bool)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum, np.uint64(2**64 - 1))
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    # a gram is an anchor of some window if it is the minimum of one: the largest minimum around it is its own hash
    edge = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, low, edge]), width, np.maximum, np.uint64(0))
    values, counts = np.unique(h[h == highest], return_counts=True)
    anchor = low[start]
    twice = counts[np.searchsorted(values, anchor)] > 1
    return start, np.diff(np.append(start, len(low))), anchor, twice


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; later rounds sort only what earlier ones left tied."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.uint64)
    # symbols are below 2^16: four to a word
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    first, tied = _groups(key[order])
    rank[order] = first
    live, width = order[tied], 4
    while len(live):
        ahead = np.zeros(len(live), np.int64)
        inside = live + width < n
        ahead[inside] = rank[live[inside] + width] + 1
        old = rank[live]
        by = np.argsort((old << 32) | ahead)
        live, old, ahead = live[by], old[by], ahead[by]
        base, _ = _groups(old)
        first, tied = _groups((old << 32) | ahead)
        rank[live] = old + first - base
        live, width = live[tied], width * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the index of the first equal one, and whether there is another equal one."""
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    return np.repeat(starts[:-1], np.diff(starts)), ~(new[:-1] & new[1:])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    n, out, step = len(text), np.zeros(len(a), np.int64), 32
    at = np.arange(step)
    for lo in range(0, len(a), 50_000):
        live = np.arange(lo, min(lo + 50_000, len(a)))
        while len(live):
            k = out[live]
            i, j = (a[live] + k)[:, None] + at, (b[live] + k)[:, None] + at
            same = (np.maximum(i, j) < n) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])
            got = np.where(same.all(1), step, same.argmin(1))
            out[live] = k + got
            live = live[got == step]
    return out


def matching_statistics(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Longest match of each position with any other, and the number of BWT runs.

    ``text``: numbers below 2^16, with a separator of its own kind after each piece (see ``joined``).
    """
    n = len(text)
    order = suffix_order(text)
    before = text[order - 1]  # the BWT; position 0 wraps round to the last separator
    change = before[1:] != before[:-1]
    heads = np.flatnonzero(np.concatenate([[True], change]))
    tails = np.flatnonzero(np.concatenate([change, [True]]))
    best = np.zeros(n, np.int64)
    for sample, other in ((heads[heads > 0], -1), (tails[tails < n - 1], 1)):
        at, next_to = order[sample], order[sample + other]
        match = np.zeros(n, np.int64)
        match[at] = _common(text, at, next_to)
        # streaming: from sample to sample the match shrinks by one per position
        reach = np.maximum.accumulate(match + np.where(match > 0, np.arange(n), 0))
        best = np.maximum(best, reach - np.arange(n))
    return best, len(heads)


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as 1..256 with separators between pieces, and the start of each piece.

    The separators are digits of the piece's number, so all suffixes differ.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    text = np.zeros(int((sizes + 2).sum()), np.uint16)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    text[at] = data.astype(np.uint16) + 1
    number = np.arange(len(pieces))
    text[starts + sizes] = 300 + number // 30_000
    text[starts + sizes + 1] = 10_300 + number % 30_000
    return text, starts


def _runs(length: int, gram: int):
    def run(batches):
        import xxhash

        for pdf in batches:
            for lo in range(0, len(pdf), 1_000):
                part = pdf.iloc[lo : lo + 1_000]
                doc, begin, count, anchors, own, two = [], [], [], [], [], []
                for k, raw in zip(part["doc"], part["text"]):
                    start, windows, anchor, twice = anchored_runs(np.frombuffer(raw, np.uint8), length, gram)
                    if len(start):
                        doc.append(np.full(len(start), k))
                        begin.append(start)
                        count.append(windows)
                        anchors.append(anchor)
                        two.append(twice)
                        own += [
                            xxhash.xxh3_64_intdigest(raw[a : a + w + length - 1])
                            for a, w in zip(start.tolist(), windows.tolist())
                        ]
                if doc:
                    yield pd.DataFrame(
                        {
                            "doc": np.concatenate(doc),
                            "start": np.concatenate(begin),
                            "windows": np.concatenate(count),
                            "anchor": np.concatenate(anchors).view(np.int64),
                            "twice": np.concatenate(two),
                            "own": np.array(own, np.uint64).view(np.int64),
                        }
                    )

    return run


def _cut_runs(length: int):
    def run(batches):
        for pdf in batches:
            out = []
            for raw, wanted in zip(pdf["text"], pdf["wanted"]):
                out += [(w["anchor"], w["own"], w["kinds"], raw[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]
            yield pd.DataFrame(out, columns=["anchor", "own", "kinds", "bytes"])

    return run


def _index(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = list(pdf["bytes"])
        text, starts = joined(pieces)
        best, _ = matching_statistics(text)
        piece = np.repeat(np.arange(len(pieces)), np.diff(np.append(starts, len(text))))
        inside = np.arange(len(text)) - starts[piece] + length <= np.array([len(b) for b in pieces])[piece]
        hit = (best >= length) & inside  # a window of bytes alone; it can only match bytes of one piece
        rise = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (piece[1:] != piece[:-1])]))
        fall = np.flatnonzero(hit & np.concatenate([~hit[1:] | (piece[1:] != piece[:-1]), [True]])) + 1
        p = piece[rise]
        return pd.DataFrame(
            {
                "anchor": pdf["anchor"].to_numpy()[p],
                "own": pdf["own"].to_numpy()[p],
                "at": rise - starts[p],
                "windows": fall - rise,
            }
        )

    return run


def _remove(length: int):
    def run(batches):
        for pdf in batches:
            size, gone, spans, sha = [], [], [], []
            for raw, marks in zip(pdf["text"], pdf["marks"]):
                keep, removed, n_spans, end = [], 0, 0, 0
                for a, b in sorted((m["at"], m["at"] + m["windows"] + length - 1) for m in ([] if marks is None else marks)):
                    if a > end or not n_spans:
                        keep.append(raw[end:a])
                        removed, n_spans, end = removed + b - a, n_spans + 1, b
                    elif b > end:
                        removed, end = removed + b - end, b
                keep.append(raw[end:])
                size.append(len(raw))
                gone.append(removed)
                spans.append(n_spans)
                sha.append(hashlib.sha256(b"".join(keep)).hexdigest())
            rest = [c for c in pdf.columns if c not in ("text", "marks")]
            yield pdf[rest].assign(n_bytes=size, n_removed=gone, n_spans=spans, kept_sha256=sha)

    return run


def repeated_windows(texts: DataFrame, length: int, grams: tuple[int, ...], heavy: int) -> DataFrame:
    """(doc, at, windows) of the windows of ``texts`` (doc: long, text: binary) that start at two places or more.

    Where more than ``heavy`` different runs share an anchor, they are not indexed together but cut again by the next,
    longer gram; grams end with ``length`` itself, at which runs with one anchor are equal. So no group grows with
    the corpus and none is dropped.
    """
    gram = grams[0]
    runs = materialize(
        texts.mapInPandas(_runs(length, gram), "doc long, start long, windows long, anchor long, twice boolean, own long")
    )
    # equal runs once, with one of their places
    different = runs.groupBy("anchor", "own").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("twice").alias("twice"),
        F.min(F.struct("doc", "start", "windows")).alias("place"),
    )
    different = materialize(different)
    anchors = different.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("places"), F.max("twice").alias("again")
    )
    anchors = materialize(anchors.where("places > 1 OR again"))
    live = different.join(anchors, "anchor")
    # equal runs at several places are repeats from end to end
    whole = live.where("n > 1").select("anchor", "own", F.lit(0).cast("long").alias("at"), F.col("place.windows").alias("windows"))
    asked = live.where("kinds > 1 OR (again AND n = 1)")
    wanted = asked.select(
        F.col("place.doc").alias("doc"), F.struct("anchor", "own", "kinds", "place.start", "place.windows").alias("w")
    )
    wanted = wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    pieces = texts.join(wanted, "doc").mapInPandas(_cut_runs(length), "anchor long, own long, kinds long, bytes binary")
    pieces = materialize(pieces.dropDuplicates(["anchor", "own"]))
    if len(grams) > 1:
        # an anchor is busy by the number of its runs or by their bytes
        large = pieces.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("__b")).where(F.col("__b") > BUSY_BYTES)
        marked = salted_left_join(pieces, materialize(large), "anchor", F.col("own"))
        is_busy = (F.col("kinds") > heavy) | F.col("__b").isNotNull()
        busy, small = marked.where(is_busy).drop("__b"), marked.where(~is_busy).drop("__b")
    else:
        busy, small = pieces.where("false"), pieces
    total = small.agg(F.sum(F.length("bytes")).alias("b")).first()["b"] or 0
    n_shards = max(1, -(-total // SHARD_BYTES))
    sharded = small.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("int"))
    found = sharded.groupBy("shard").applyInPandas(_index(length), "anchor long, own long, at long, windows long")
    marks = whole.unionByName(found)
    if not busy.isEmpty():
        named = busy.withColumn("doc", F.xxhash64("anchor", "own"))
        again = repeated_windows(named.select("doc", F.col("bytes").alias("text")), length, grams[1:], heavy)
        marks = marks.unionByName(again.join(named, "doc").select("anchor", "own", "at", "windows"))
    marks = marks.groupBy(F.struct("anchor", "own").alias("run")).agg(F.collect_list(F.struct("at", "windows")).alias("marks"))
    placed = salted_left_join(runs.select(F.struct("anchor", "own").alias("run"), "doc", "start"), materialize(marks), "run", F.col("doc"))
    return placed.where("marks IS NOT NULL").selectExpr(
        "doc", "inline(transform(marks, m -> struct(start + m.at AS at, m.windows AS windows)))"
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    grams: tuple[int, ...] = (128, 256, 384, 400),
    heavy: int = 2_000,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte in a ``length``-byte string that starts at two places or more of all texts, the same text
    included. Texts are UTF-8 bytes, NULL is the empty text, matches never cross texts; a text shorter than
    ``length`` loses nothing. Rows that repeat a text, with or without its id, count as places of their own, and so
    lose all of it if it is long enough. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"),
    )
    long_rows = rows.where(F.length("text") >= length).select("doc", "text")
    marks = repeated_windows(long_rows, length, grams, heavy)
    by_doc = marks.groupBy("doc").agg(F.collect_set(F.struct("at", "windows")).alias("marks"))
    out = rows.join(by_doc, "doc", "left").select("__id", "text", "marks")
    schema = f"__id {rows.schema['__id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return out.mapInPandas(_remove(length), schema).withColumnRenamed("__id", id_col)
