"""Spelling variants by a trie of letter-group counts.

Words are counted per task and combined by Spark. A word is then the list of its letter-group counts: its length
first, then how often it has each group of ``GROUPS``. One inserted, deleted or replaced letter adds at most one
to one count (a surplus) and takes at most one from another (a deficit), so the words near a word lie on paths of
the trie of these counts that spend a budget of one surplus and one deficit.

The trie is dealt out by its upper levels. Every word is a resident of the node on its own path and a visitor of all
nodes its budget can reach; a node with more than ``NODE`` residents is opened by one more level, until none is left
(``placed``). A node's residents and a bounded share of its visitors are one task, which builds the lower part of the
trie and searches it depth-first for all its visitors at once. The words of the leaves are verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .common import salted_left_join
from .workers import give_back

#: Letters in order of use, then the letters from U+00C0 to U+00FF eight at a time.
GROUPS = [*"eainrstoludcmpghbfvkwjqxyz", *("".join(map(chr, range(c, c + 8))) for c in range(0xC0, 0x100, 8))]
#: Residents of one task, and visitors of one task.
NODE, VISITORS = 16_384, 65_536
LEAF = 6
PAIR_BYTES = 4_000_000
HELD = 400_000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_KEEP).decode("latin-1").encode().split()


def _count(least_chars: int, one_in: int):
    def flush(held):
        words = [w.decode() for w in held]
        rows = [(w, n) for w, n in zip(words, held.values()) if n > 0 and len(w) >= least_chars]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"]
        )

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("__id").to_pylist(), batch.column("__text")):
                found = runs(text.as_py() or "")
                held.update(found)
                if one_in:
                    distinct, seed = set(found), zlib.crc32(f"{doc}:".encode())
                    changed = [(w, h) for w, h in zip(distinct, map(zlib.crc32, distinct, repeat(seed))) if h % one_in == 0]
                    for w, h in changed:
                        n, word = found.count(w), w.decode()
                        at = h % len(word)
                        held[w] -= n
                        held[(word[:at] + word[at + 1 :]).encode()] += n
                if len(held) >= HELD:
                    yield flush(held)
            give_back()
        yield flush(held)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n): occurrences of each word of at least ``least_chars`` letters, where there are ``least_count`` or more.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``one_in`` loses its letter at crc32 modulo length in that
    document (0: none does); a NULL id is empty there. NULL texts have no words.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(ident.alias("__id"), F.col(text_col).alias("__text"))
    parts = rows.mapInArrow(_count(least_chars, one_in), "word string, n long")
    return materialize(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def _group_count(group: str) -> Column:
    return F.length("word") - F.length(F.translate("word", group, ""))


def placed(words: DataFrame, most: int = NODE) -> DataFrame:
    """(node, word, n, own): residents (own) and visitors of nodes with at most ``most`` residents, or of full depth."""
    size = F.length("word")
    residents = words.select("word", "n", F.lit(True).alias("own"), *(F.lit(0).alias(c) for c in ("more", "less")), size.cast("string").alias("node"))
    options = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(m).alias("more"), F.lit(s).alias("less")) for d, m, s in ((-1, 0, 1), (0, 1, 1), (1, 1, 0))))
    visitors = words.select("word", "n", F.explode(options).alias("o")).select(
        "word", "n", F.lit(False).alias("own"), "o.more", "o.less", (size + F.col("o.d")).cast("string").alias("node")
    )
    rows, done = residents.union(visitors), []
    for level, group in enumerate([*GROUPS, None]):
        rows = materialize(rows)
        sizes = materialize(rows.where("own").groupBy("node").agg(F.count(F.lit(1)).alias("__n")))
        # visitors of a node without residents have nothing to find
        rows = salted_left_join(rows, sizes, "node", F.col("word")).where("__n IS NOT NULL")
        if group is None or sizes.where(F.col("__n") > most).isEmpty():
            done.append(rows.select("node", "word", "n", "own"))
            break
        done.append(rows.where(F.col("__n") <= most).select("node", "word", "n", "own"))
        steps = F.array_compact(
            F.array(
                F.struct(F.lit(0).alias("d"), F.col("more"), F.col("less")),
                F.when(F.col("more") > 0, F.struct(F.lit(1).alias("d"), F.lit(0).alias("more"), F.col("less"))),
                F.when(F.col("less") > 0, F.struct(F.lit(-1).alias("d"), F.col("more"), F.lit(0).alias("less"))),
            )
        )
        opened = rows.where(F.col("__n") > most).withColumn("o", F.explode(steps)).withColumn("c", _group_count(group) + F.col("o.d"))
        rows = opened.where("c >= 0").select("word", "n", "own", "o.more", "o.less", F.concat_ws(",", "node", F.col("c").cast("string")).alias("node"))
    return reduce(DataFrame.unionByName, done)


def counts_of(words: list[str]) -> np.ndarray:
    """Length and letter-group counts, a row a word."""
    group = np.full(256, len(GROUPS))
    for k, letters in enumerate(GROUPS):
        group[[ord(c) for c in letters]] = k
    out = np.zeros((len(words), len(GROUPS) + 2), np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(words)), sizes), group[letters] + 1), 1)
    out[:, 0] = sizes
    return out[:, :-1]


def leaves(own: np.ndarray, visiting: np.ndarray, leaf: int = LEAF):
    """(residents, visitors) of the leaves that depth-first search reaches; ``own`` is sorted by its rows."""
    depth_end = own.shape[1]

    def search(lo, hi, depth, who, more, less):
        if hi - lo <= leaf or (hi - lo) * len(who) <= 4 * leaf or depth == depth_end:
            yield np.arange(lo, hi), who
            return
        column = own[lo:hi, depth]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), hi - lo]
        mine = visiting[who, depth]
        for a, b in zip(cuts, cuts[1:]):
            step = column[a] - mine
            ok = np.flatnonzero((step == 0) | ((step == 1) & more) | ((step == -1) & less))
            if len(ok):
                taken = step[ok]
                yield from search(lo + a, lo + b, depth + 1, who[ok], more[ok] & (taken != 1), less[ok] & (taken != -1))

    column, mine = own[:, 0], visiting[:, 0]
    cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(own)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            step = column[a] - mine
            who = np.flatnonzero(np.abs(step) <= 1)
            if len(who):
                yield from search(a, b, 1, who, step[who] >= 0, step[who] <= 0)


def one_apart(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether words differ by exactly one letter; rows are letters from the left (a, b) and from the right (a_end, b_end)."""
    head = np.logical_and.accumulate(a == b, 1).sum(1)
    tail = np.logical_and.accumulate(a_end == b_end, 1).sum(1)
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return np.where(most == least, (head < least) & (head + tail == least - 1), (most == least + 1) & (head + tail >= least))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(map(len, words), default=0) + 1
    fill = lambda ws: np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in ws), np.uint8).reshape(-1, width)
    return fill(words), fill(w[::-1] for w in words), np.fromiter(map(len, words), np.int64, len(words))


def near_in_node(residents: list[str], n: np.ndarray, visitors: list[str]) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the visitors with a near word among the residents."""
    order = np.lexsort(counts_of(residents).T[::-1])
    residents, n = [residents[i] for i in order], n[order]
    own, visiting = counts_of(residents), counts_of(visitors)
    left, right, size = _letters([*residents, *visitors])
    base, width = len(residents), left.shape[1]
    near = np.zeros(len(visitors), np.int64)
    best: dict[int, tuple[int, str]] = {}

    def verify(at: np.ndarray, who: np.ndarray) -> None:
        x, y = at, who + base
        ok = one_apart(left[x], left[y], size[x], size[y], right[x], right[y])
        at, who = at[ok], who[ok]
        np.add.at(near, who, 1)
        for k, v, w in zip(n[at].tolist(), who.tolist(), at.tolist()):
            if v not in best or (-k, residents[w]) < best[v]:
                best[v] = (-k, residents[w])

    held, rows, most = [], 0, max(1, PAIR_BYTES // width)
    for at, who in leaves(own, visiting):
        step = max(1, most // max(1, len(at)))
        for k in range(0, len(who), step):
            some = who[k : k + step]
            held.append((np.repeat(at, len(some)), np.tile(some, len(at))))
            rows += len(at) * len(some)
            if rows >= most:
                verify(*(np.concatenate(c) for c in zip(*held)))
                held, rows = [], 0
    if held:
        verify(*(np.concatenate(c) for c in zip(*held)))
    found = sorted(best)
    return pd.DataFrame(
        {
            "word": pd.Series([visitors[v] for v in found], dtype=object),
            "n_near": near[found],
            "form_n": np.array([-best[v][0] for v in found], np.int64),
            "form": pd.Series([best[v][1] for v in found], dtype=object),
        }
    )


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf["own"].to_numpy(bool)
    out = near_in_node(pdf["word"][own].tolist(), pdf["n"][own].to_numpy(np.int64), pdf["word"][~own].tolist())
    give_back()
    return out


def near_words(words: DataFrame, most: int = NODE, visitors: int = VISITORS) -> DataFrame:
    """(word, n_near, form_n, form): how many words are near a word, and the one of the largest n (ties: first in order)."""
    rows = materialize(placed(words, most))
    visited = rows.where("NOT own").groupBy("node").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("__parts"))
    rows = salted_left_join(rows, materialize(visited), "node", F.col("word")).where("__parts IS NOT NULL")
    part = F.when(F.col("own"), F.sequence(F.lit(0), F.col("__parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("word"), F.col("__parts")).cast("int"))
    )
    tasks = rows.select("node", F.explode(part).alias("part"), "word", "n", "own").groupBy("node", "part")
    found = tasks.applyInPandas(_near, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best")
    ).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from ``word`` by following ``forms`` (word, form; never in a circle)."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        up = ways.select(F.col("word").alias("root"), F.col("root").alias("__up"))
        ways = materialize(salted_left_join(ways, up, "root", F.col("word")).select("word", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("__moved")))
        if ways.where("__moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, **how) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced letter apart. ``form`` is the near word of the largest n
    (ties: first in order) if that is at least ``ratio`` times the word's own; ``root`` follows forms to the last word.
    Other columns of ``docs`` are ignored; an empty table or one without words gives no rows, and repeated rows count
    as often as they occur. ``how`` goes to ``word_counts``.
    """
    words = word_counts(docs, id_col, text_col, **how)
    near = materialize(near_words(words))
    known = words.join(near, "word", "left").withColumn("__has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    known = materialize(
        known.select(
            "word",
            F.when(F.col("__has"), F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("__has"), F.col("form_n")).alias("form_n"),
        )
    )
    roots = with_roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
