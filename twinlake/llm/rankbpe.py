"""BPE encoding and decoding with a contiguous rank array per word.

A text is cut into the tokenizer's words, and each distinct word is encoded once while a worker remembers it. A word starts as one part per byte. Two short contiguous lists hold its parts and the rank of every adjacent
pair; the smallest rank is found by scanning, its boundary is deleted, and the ranks of the two neighbouring pairs
are looked up anew, until no pair can be merged. Scanning is quadratic in the length, so words of more than
``SHORT`` bytes keep their ranks in a heap over linked parts, with the same merges in the same order. Rows are
independent: nothing is shuffled, and a lost task repeats only its own slice.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import slices
from .workers import give_back, kept

SHORT = 400
#: Words whose ids a worker remembers, in two generations: what the newer half did not need is forgotten.
REMEMBERED = 600_000
_NONE = 1 << 62
_BITS = 20
_LOW = (1 << _BITS) - 1

#: The vocabulary's word rule for lower-case ASCII and Latin-1 texts (both are composed already). In other
#: texts a chunk with characters beyond ASCII is taken whole.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\s]+"
_ASCII = re.compile(_RULE, re.A)
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\s\x85\xa0]+", re.A
)
_MIXED = re.compile(r"(?<!\S)\S*[^\x00-\x7f]\S*|" + _RULE, re.A)


class RankBpe:
    """Ids of texts under a vocabulary file with ranked merges, word ends and added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, whole = spec["model"], Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special)).lower()
        tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.first = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t[:1]: i for t, i in vocab.items() if len(t) == 1 + len(end) and t.endswith(end)}
        # pair of ids -> rank and id of the merged part in one number, so that the smallest number has the smallest rank
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << _BITS | vocab[b], rank << _BITS | vocab[a + b])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(printable)))}
        self.first_of, self.last_of = ([ids[shown[b]] for b in range(256)] for ids in (self.first, self.last))
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """The parts left after all merges: smallest rank first, leftmost of equals."""
        get = self.pairs.get
        if len(parts) > SHORT:
            return self._linked(parts)
        ranks = [get(a << _BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = best & _LOW
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << _BITS | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << _BITS | parts[i], _NONE)
        return parts

    def _linked(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << _BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << _BITS | parts[j]) != rank:
                continue
            parts[i], parts[j] = rank & _LOW, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << _BITS | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] << _BITS | parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one word, written with the vocabulary's character for each byte."""
        return self.merged([*(self.first[c] for c in word[:-1]), self.last[word[-1]]])

    def learn(self, piece: str, whole: bool) -> tuple[int, ...]:
        """Ids of a whole word, or of a chunk that may hold several; remembered if it is short."""
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            if whole:
                ids = tuple(self.merged([*map(self.first_of.__getitem__, raw[:-1]), self.last_of[raw[-1]]]))
            else:  # composition, case and classes beyond Latin-1 are the tokenizer's own
                words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece))
                ids = tuple(chain.from_iterable(self.word(w) for w, _ in words))
        if len(piece) <= SHORT:
            self.known[piece] = ids
        return ids

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the pieces of a text whose A-Z are lower-cased."""
        latin = text.isascii() or _is_latin(text)
        if latin:
            found = _ASCII.findall(text) if text.isascii() else _LATIN.findall(text.lower())
        else:
            found = _MIXED.findall(text)
        ids = list(map(self.known.get, found))
        if None in ids:
            known = self.known
            for k, i in enumerate(ids):
                if i is None:
                    piece = found[k]
                    ids[k] = known.get(piece) or self.learn(piece, latin or piece.isascii())
        return ids

    def with_added(self, text: str) -> list[tuple[int, ...]]:
        """The same for a text with added tokens, which are found before lower-casing."""
        out = []
        for part in self.cut.split(text):
            out += [(self.special[part],)] if part in self.special else self.pieces(pc.ascii_lower(part).as_py())
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; none for a NULL."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        texts = pc.fill_null(texts, "")
        raw = texts.to_pylist() if self.cut else None
        parts, sizes = [], []
        for k, text in enumerate(pc.ascii_lower(texts).to_pylist()):
            added = self.cut and self.mark in text and self.cut.search(raw[k])
            ids = list(chain.from_iterable(self.with_added(raw[k]) if added else self.pieces(text)))
            sizes.append(len(ids))
            parts.append(np.array(ids, np.int32))
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        return pa.ListArray.from_arrays(pa.array(_offsets(np.array(sizes, np.int64)), pa.int32()), pa.array(flat))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list joined by blanks, as a tokenizer without decoder does; unknown ids are left out."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sound = (values >= 0) & (values < len(self.tokens))
        tokens = self.tokens.take(pa.array(np.where(sound, values, 0)))
        known = sound & tokens.is_valid().to_numpy(zero_copy_only=False)
        if not known.all():
            tokens = tokens.filter(pa.array(known))
        kept_of = _offsets(known.astype(np.int64))[_offsets(sizes)]
        lists = pa.LargeListArray.from_arrays(pa.array(kept_of, pa.int64()), tokens.cast(pa.large_string()))
        joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string()))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _encoder(vocabulary: str) -> RankBpe:
    import public_tokenizers

    cache = kept("rankbpe")
    if vocabulary not in cache:
        cache[vocabulary] = RankBpe(public_tokenizers.path(vocabulary))
    return cache[vocabulary]


def _encoded(vocabulary: str):
    def run(batches):
        coder = _encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids = coder.encode(batch.column("__text"))
                rest = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), ids], names=[*rest, "ids"])
            give_back()

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int). Other columns are ignored, whatever their names.

    NULL, empty and blank texts have no ids. Added tokens in a text become their own ids; a text is encoded whole,
    however long it is, and repeated rows stay. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(_encoded(vocabulary), schema)


def _decoded(vocabulary: str, ids_col: str, out: str):
    def run(batches):
        coder = _encoder(vocabulary)
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // 1_000_000
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                text = coder.decode(batch.column(ids_col))
                rest = [n for n in batch.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), text], names=[*rest, out])
            give_back()

    return run


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``rows`` with the text of ``ids_col`` as the last column ``out``, which replaces a column of that name.

    Special tokens are kept. NULL gives NULL, no ids the empty text; ids outside the vocabulary are left out.
    """
    numbers = rows.withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    schema = T.StructType([*(f for f in numbers.schema if f.name != out), T.StructField(out, T.StringType())])
    return numbers.mapInArrow(_decoded(vocabulary, ids_col, out), schema)
