"""Packing by concatenate-and-cut.

First pass: every partition tokenizes its documents and writes them with their position in the partition's token
stream. The prefix sum over the partitions' totals turns positions into global offsets. Second pass: each document
is cut where it crosses a multiple of the window; the pieces at either side of a cut are the boundary records. That
pass is column expressions over the written ids, so it sends nothing to Python. No token is shuffled: the only table
that meets in one place has one row per partition.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.scratch import materialize

from .workers import TEXT_BATCH, batches_of, give_back, kept

#: Chunks and words whose ids a worker remembers between tasks; those not used lately are forgotten first.
KEPT_PIECES = 200_000
SLICE_BYTES = TEXT_BATCH
#: Chunks whose ids are put together at once, to bound the arrays of positions.
BLOCK = 1 << 16
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
#: Latin-1 letters: a run of them is one word for certain, whatever their case, and so is what follows of punctuation.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_WORD = re.compile(f"[{LETTERS}]+")


class WordIds:
    """Token ids of whitespace-free chunks, each distinct piece encoded once while it is remembered."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lengths, self.lately = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self._remember([""], np.zeros(0, self.dtype), np.zeros(1, np.int64))

    def _remember(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add pieces whose ids stand end to end."""
        at, n = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.starts):
            self.starts, self.lengths, self.lately = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.lately))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : at + n] = lengths
        self.known.update(zip(pieces, range(at, at + n)))
        self.used += len(ids)

    def _forget(self) -> None:
        """Keep what was used since the last time, if that is less than half of what may be kept."""
        old = [(p, i) for p, i in self.known.items() if self.lately[i] and p]
        flat, starts, lengths = self.flat, self.starts, self.lengths
        self.clear()
        if old and 2 * len(old) <= KEPT_PIECES:
            at = np.array([i for _, i in old])
            self._remember([p for p, _ in old], _gather(flat, starts[at], lengths[at]), lengths[at])

    def learn(self, words: list[str], others: list[str]) -> None:
        """Encode words (one token sequence with one word end each) joined by spaces, the rest one by one."""
        for k in range(0, len(words), 2000):
            group = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                self._remember(group, ids, np.diff(cuts, prepend=0))
            else:
                others = [*others, *group]
        for k in range(0, len(others), 2000):
            part = others[k : k + 2000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._remember(part, np.array(list(chain.from_iterable(found)), self.dtype), np.array(list(map(len, found)), np.int64))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of each piece stand; unknown ones are learned."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.known]
        if fresh:
            self.learn([p for p in fresh if _WORD.fullmatch(p)], [p for p in fresh if not _WORD.fullmatch(p)])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.lately[at] = True
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        if len(self.known) > KEPT_PIECES:
            self._forget()
        # added tokens are matched before lower-casing, so texts that may hold some are not lower-cased here
        added = pc.any(pc.match_substring(texts, "<|")).as_py()
        split = pc.ascii_split_whitespace(texts if added else pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        # a chunk of letters with punctuation behind it is two pieces, any other chunk is one
        head = pc.utf8_rtrim(coded.dictionary, characters=PUNCTUATION)
        shaped = pc.equal(pc.utf8_ltrim(head, characters=LETTERS), "")
        word = self._places(pc.if_else(shaped, head, coded.dictionary))
        rest = self._places(pc.if_else(shaped, pc.utf8_ltrim(coded.dictionary, characters=LETTERS), ""))
        code = coded.indices.to_numpy(zero_copy_only=False)
        chunks = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        del split, coded, head, shaped
        sizes = (self.lengths[word] + self.lengths[rest])[code]
        ids, done = np.empty(int(sizes.sum()), self.dtype), 0
        for k in range(0, len(code), BLOCK):
            mine = code[k : k + BLOCK]
            at = np.stack([word[mine], rest[mine]], 1).ravel()
            part = _gather(self.flat, self.starts[at], self.lengths[at])
            ids[done : done + len(part)] = part
            done += len(part)
        return ids, _sums(sizes, chunks)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length] end to end."""
    out = np.empty(int(lengths.sum()), flat.dtype)
    most, at = 1 << 18, 0
    ends = np.cumsum(lengths)
    while at < len(starts):
        base = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        n = lengths[at:to]
        first = np.repeat(starts[at:to] - (ends[at:to] - n - base), n)
        out[base : ends[to - 1]] = flat[first + np.arange(len(first))]
        at = to
    return out


def word_ids(path: str) -> WordIds:
    """The worker's own encoder: Python workers live longer than tasks, so the vocabulary is read once."""
    cache = kept("packing")
    if path not in cache:
        cache[path] = WordIds(path)
    return cache[path]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in parts of about ``most`` bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _tokenize(vocabulary: str, end_id: int):
    def run(batches):
        import public_tokenizers

        words = word_ids(public_tokenizers.path(vocabulary))
        part, seen = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "__text"):
                text = pc.fill_null(batch.column("__text"), "")
                ids, counts = words.encode(text)
                counts = counts.astype(np.int64)
                ends = np.cumsum(counts)
                raw, tail = memoryview(ids.astype("<u4").tobytes()), np.array([end_id], "<u4").tobytes()
                blobs = [bytes(raw[(e - n) * 4 : e * 4]) + tail for e, n in zip(ends.tolist(), counts.tolist())]
                counts = counts + 1
                local = seen + np.cumsum(counts) - counts
                seen += int(counts.sum())
                rest = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in rest]
                    + [
                        pa.array(np.full(len(counts), part), pa.int32()),
                        pa.array(local, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=[*rest, "__part", "__local", "__tokens", "__ids"],
                )
                del text, ids, raw, blobs
                give_back()

    return run


def _pieces(at: Column, n: Column, ids: Column, window: int) -> Column:
    """Array of (start, length, ids_crc32): the pieces of a document of ``n`` ids (4 bytes each) that begins at ``at``."""
    windows = F.sequence(F.call_function("div", at, F.lit(window)), F.call_function("div", at + n - 1, F.lit(window)))
    cuts = F.transform(
        windows,
        lambda k: F.struct(F.greatest(k * window - at, F.lit(0)).alias("a"), F.least((k + 1) * window - at, n).alias("b")),
    )
    of = lambda c: F.substring(ids, (4 * c["a"] + 1).cast("int"), (4 * (c["b"] - c["a"])).cast("int"))
    return F.transform(
        cuts,
        lambda c: F.struct(
            c["a"].cast("long").alias("start"), (c["b"] - c["a"]).cast("long").alias("length"), F.crc32(of(c)).alias("ids_crc32")
        ),
    )


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Documents with their ids and their place: partition and tokens before them there. Written once."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    more = [
        T.StructField("__part", T.IntegerType()),
        T.StructField("__local", T.LongType()),
        T.StructField("__tokens", T.LongType()),
        T.StructField("__ids", T.BinaryType()),
    ]
    schema = T.StructType([rows.schema[id_col], *more])
    with batches_of(docs.sparkSession, SLICE_BYTES):
        return materialize(rows.mapInArrow(_tokenize(vocabulary, end_id), schema))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    window: int = 4096,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and ``end_id``; NULL and blank texts are the end id alone. All sequences but the last
    are full. Repeated rows are packed as often as they occur. Other columns are ignored. No rows give no pieces.
    """
    rows = tokenized(docs, id_col, text_col, vocabulary, end_id)
    totals = rows.groupBy("__part").agg(F.sum("__tokens").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__base"))
    # one row per task of the first pass
    placed = rows.join(F.broadcast(bases), "__part").withColumn("__at", F.col("__base") + F.col("__local"))
    pieces = _pieces(F.col("__at"), F.col("__tokens"), F.col("__ids"), window)
    cut = placed.select(id_col, "__at", F.col("__tokens").alias("doc_tokens"), F.inline(pieces))
    place = F.col("__at") + F.col("start")
    return cut.select(
        id_col,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.call_function("div", place, F.lit(window)).alias("sequence_id"),
        F.pmod(place, F.lit(window)).cast("long").alias("offset"),
    )
