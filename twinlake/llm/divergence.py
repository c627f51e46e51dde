"""Which sources of a language differ, and by which terms.

Terms are counted per task and combined by Spark, once per language, source and term. All shares are whole numbers in
parts of 10^9 and all arithmetic is exact in 64 bits, for languages of up to 10^8 kept terms and 10^15 occurrences.

Pairs of sources: a term missing in a source has that source's one base share there, so the sum over all kept terms
splits into the terms both sources have (a join of sources that share a term, summed before the shuffle), the terms
of one source (a histogram of its shares against each other source's base) and the number of the rest.

Terms of a source: a term's divergence never falls when its count in the source rises or its count in the language
falls. So a term that at least ``k`` others dominate (group count as high or higher, language count as low or lower,
earlier in UTF-8) is not among the first k. Partitions of a group keep their skybands, the terms dominated by fewer
than k others; the skybands are merged in the same way, and what is left is ranked exactly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .common import SALTS, salted_left_join
from .workers import give_back

HELD = 400_000
#: Terms of a group that one task reduces to their skyband.
PART = 8_192

_TERM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def _flush(held: dict):
    lang, source, term, n, docs = [], [], [], [], []
    for (l, s), (counts, seen) in held.items():
        lang += [l] * len(counts)
        source += [s] * len(counts)
        term += [t.decode() for t in counts]
        n += counts.values()
        docs += [seen[t] for t in counts]
    held.clear()
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _count(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    rows = 0
    for batch in batches:
        lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for l, s, text in zip(lang, source, batch.column("text")):
            if (l, s) not in held:
                held[l, s] = Counter(), Counter()
            counts, seen = held[l, s]
            rows -= len(counts)
            terms = memoryview(text.as_buffer() or b"").tobytes().translate(_TERM).split()
            counts.update(terms)
            seen.update(set(terms))
            rows += len(counts)
            if rows >= HELD:
                yield _flush(held)
                rows = 0
        give_back()
    yield _flush(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of texts (lang, source, text; no NULLs): occurrences, and texts with the term."""
    parts = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return materialize(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share_sql(n: str, of: str) -> str:
    """1 + floor(10^9 * n / of), three decimal digits at a time; n is at most ``of``."""
    a, b = f"(({n}) * 1000)", f"((({n}) * 1000 % ({of})) * 1000)"
    c = f"(({b} % ({of})) * 1000)"
    return f"(1L + {a} div ({of}) * 1000000L + {b} div ({of}) * 1000L + {c} div ({of}))"


def gap_sql(p: str, q: str) -> str:
    """floor((p - q)^2 / q)"""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def survivors(high: np.ndarray, low: np.ndarray, order: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Positions dominated by fewer than k others: as high or higher, as low or lower, and earlier."""
    by = np.lexsort((order, low, -high))  # whoever dominates comes first
    low, order = low[by], order[by]
    kept = np.zeros(0, np.int64)
    for at in range(0, len(by), block):
        mine = np.arange(at, min(at + block, len(by)))
        n = ((low[kept][None, :] <= low[mine][:, None]) & (order[kept][None, :] < order[mine][:, None])).sum(1)
        within = (low[mine][None, :] <= low[mine][:, None]) & (order[mine][None, :] < order[mine][:, None])
        n += np.tril(within, -1).sum(1)
        kept = np.concatenate([kept, mine[n < k]])
    return by[kept]


def _skyband(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = pdf["term"].tolist()
        order = np.empty(len(terms), np.int64)
        order[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        stay = survivors(pdf["n"].to_numpy(), pdf["lang_n"].to_numpy(), order, k)
        out = pdf.iloc[np.sort(stay)][["lang", "source", "term", "n", "lang_n", "value"]]
        give_back()
        return out

    return run


def skybands(rows: DataFrame, k: int, part: int = PART) -> DataFrame:
    """``rows`` (lang, source, term, n, lang_n, value) without those that k others of their group dominate in a part."""
    fields = "lang string, source string, term string, n long, lang_n long, value long"
    left = materialize(rows)
    while True:
        keyed = left.withColumn("__group", F.struct("lang", "source"))
        sizes = materialize(keyed.groupBy("__group").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("__parts")))
        cut = salted_left_join(keyed, sizes, "__group", F.col("term"))
        cut = cut.withColumn("__part", F.pmod(F.xxhash64("term"), F.col("__parts")))
        before, left = left, materialize(cut.groupBy("lang", "source", "__part").applyInPandas(_skyband(k), fields))
        # one part each, or too little gained: the ranking sorts what is left
        if sizes.where("__parts > 1").isEmpty() or 2 * left.count() > before.count():
            return left


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, k: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occurs.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its documents. Part ``pair``: every other source of the language with its divergence over all kept
    terms, 0 if there are none. Part ``term``: the first ``k`` terms more frequent in the source than in the language.
    Ranks go by value, then by the item's UTF-8. NULL text, language and source are ''; repeated rows count as often as
    they occur; other columns are ignored. An empty table gives no rows, a language of one source no pairs.
    """
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = term_counts(rows)
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"lang_n": F.sum("n").over(of_term), "__docs": F.sum("docs").over(of_term)})
    kept = materialize(kept.where(F.col("__docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"))

    # one row per group, with its own and its language's totals and base share
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("own_terms"))
    words = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(words, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("own_n", "own_terms", "lang_total", "terms")))
    groups = materialize(groups.withColumn("base", F.when(F.col("terms") > 0, F.expr(share_sql("1L", "nullif(own_n + terms, 0)")))))

    facts = groups.select(F.struct("lang", "source").alias("__group"), "own_n", "lang_total", "terms", "base")
    shared = salted_left_join(kept.withColumn("__group", F.struct("lang", "source")), facts, "__group", F.col("term"))
    shared = shared.withColumns({"p": F.expr(share_sql("n + 1", "own_n + terms")), "q": F.expr(share_sql("lang_n + 1", "lang_total + terms"))})
    shared = materialize(shared.select("lang", "source", "term", "n", "lang_n", "p", "q", "base"))

    more = shared.where("p > q").select("lang", "source", "term", "n", "lang_n", F.expr(gap_sql("p", "q")).alias("value"))
    terms = skybands(more, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    pairs = _pairs(shared, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= k))


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""

    def corrected(p, q, p0, q0):
        """A shared term's gap, less what the one-sided sums count for it."""
        return F.expr(f"{gap_sql(p, q)} - {gap_sql(p, q0)} - {gap_sql(p0, q)} + {gap_sql(p0, q0)}")

    a = shared.select("lang", "term", F.col("source").alias("sa"), F.col("p").alias("pa"), F.col("base").alias("a0"))
    b = shared.select("lang", "term", F.col("source").alias("sb"), F.col("p").alias("pb"), F.col("base").alias("b0"))
    met = a.join(b, ["lang", "term"]).where("sa < sb")
    met = met.groupBy("lang", "sa", "sb").agg(
        F.sum(corrected("pa", "pb", "a0", "b0")).alias("ab"), F.sum(corrected("pb", "pa", "b0", "a0")).alias("ba")
    )
    met = materialize(met)
    both = met.selectExpr("lang", "sa AS source", "sb AS item", "ab AS value").unionAll(met.selectExpr("lang", "sb", "sa", "ba"))

    # a source's shares, each with its number of terms, against the base of every other source of the language
    steps = shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    steps = steps.withColumn("__salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("o0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    sided = steps.join(others, ["lang", "__salt"]).where("source <> other")
    sided = sided.groupBy("lang", "source", "other").agg(
        F.sum(F.expr(f"m * {gap_sql('p', 'o0')}")).alias("out"), F.sum(F.expr(f"m * {gap_sql('o0', 'p')}")).alias("back")
    )
    sided = materialize(sided)
    both = both.unionAll(sided.selectExpr("lang", "source", "other", "out")).unionAll(sided.selectExpr("lang", "other", "source", "back"))

    x = groups.select("lang", "source", "terms", F.col("own_terms").alias("nx"), F.col("base").alias("x0"))
    y = groups.select("lang", F.col("source").alias("item"), F.col("own_terms").alias("ny"), F.col("base").alias("y0"))
    rest = x.join(y, "lang").where("source <> item")
    rest = rest.select("lang", "source", "item", F.expr(f"coalesce((terms - nx - ny) * {gap_sql('x0', 'y0')}, 0L)").alias("value"))
    return rest.unionAll(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
