"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to letters and single blanks. All labelled rows that may be learned from are counted: every task
counts its own 4-grams first and Spark adds the counts up. From the counts each language gets an interpolated
Kneser-Ney model of order 4, stored as sorted arrays of 64-bit n-gram codes (four characters of 16 bits) with
binary-search lookups. A text gets the language with the lowest cross-entropy per character. Rejection is calibrated
on all labelled rows, language by language: a text is rejected when it has no letter, or when its cross-entropy under
the best model is far outside what texts of that language have.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.scratch import materialize

from .workers import TEXT_BATCH, batches_of, give_back, kept

ORDER = 4
BLANK = 32


def _folding() -> np.ndarray:
    """Lower-case letter for each code point below 65536, blank for anything else; higher letters share one code."""
    cache = kept("langid")
    if "folding" not in cache:
        table = np.full(65_536, BLANK, np.uint16)
        for c in range(65_536):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 65_536 else c
        cache["folding"] = table
    return cache["folding"]


def fold(text: str | None) -> np.ndarray:
    """Codes of a text: letters lower-cased, runs of anything else one blank, a blank at both ends."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _folding()
    codes = np.empty(len(raw) + 2, np.uint16)
    codes[0] = codes[-1] = BLANK
    if len(raw) and raw.max() >= 65_536:
        high = raw >= 65_536
        codes[1:-1] = np.where(high, 0xFFFF, table[np.minimum(raw, 65_535)])
        for k in np.flatnonzero(high):
            if not unicodedata.category(chr(raw[k])).startswith("L"):
                codes[k + 1] = BLANK
    else:
        codes[1:-1] = table[raw]
    blank = codes == BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return codes[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """One 64-bit code per character after the first: the character and the three before it (blanks in front)."""
    c = np.concatenate([np.full(ORDER - 2, BLANK, np.uint16), codes]).astype(np.uint64)
    n = len(c) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k : k + n]
    return out


def _count(batches):
    """(lang, gram, n) per batch of (lang, text)."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            held, size = [], 0
            for text in texts:
                held.append(grams(fold(text)))
                size += len(held[-1])
                if size > 750_000:
                    yield _tally(lang, held)
                    held, size = [], 0
            if held:
                yield _tally(lang, held)
        give_back()


def _tally(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
    codes, uniques = pd.factorize(np.concatenate(held).view(np.int64))
    return pd.DataFrame({"lang": lang, "gram": uniques, "n": np.bincount(codes, minlength=len(uniques))})


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 else 0.5


@dataclass
class KneserNey:
    """Sorted arrays per order: codes and discounted log-free probabilities; contexts and their backoff weights."""

    codes: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: float

    @staticmethod
    def fit(gram: np.ndarray, n: np.ndarray) -> KneserNey:
        order = np.argsort(gram)
        code, count = gram[order], n[order].astype(np.float64)
        levels = [(code, count)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: different characters in front
            mask = np.uint64((1 << (16 * k)) - 1)
            code, count = np.unique(code & mask, return_counts=True)
            levels.append((code, count.astype(np.float64)))
        levels.reverse()
        vocabulary = len(levels[0][0]) + 1
        out = KneserNey([], [], [], [], 1.0 / vocabulary)
        for k, (code, count) in enumerate(levels):
            context = code >> np.uint64(16) if k else np.zeros(len(code), np.uint64)
            ctx, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            d = _discount(count)
            lower = out.prob(code, k)  # the model built so far, of order k
            back = d * kinds / total
            out.contexts.append(ctx)
            out.backoffs.append(back)
            out.codes.append(code)
            out.probs.append(np.maximum(count - d, 0) / total[at] + back[at] * lower)
        return out

    def prob(self, gram: np.ndarray, orders: int = ORDER) -> np.ndarray:
        """Interpolated probability of the last character of each code given up to ``orders`` - 1 before it."""
        p = np.full(len(gram), self.floor)
        for k in range(orders):
            code = gram & np.uint64((1 << (16 * (k + 1))) - 1) if k < 3 else gram
            context = code >> np.uint64(16) if k else np.zeros(len(gram), np.uint64)
            seen, at = _find(self.contexts[k], context)
            p = np.where(seen, self.backoffs[k][at] * p, p)
            hit, at = _find(self.codes[k], code)
            p = np.where(hit, self.probs[k][at], p)
        return p


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


@dataclass
class LanguageModel:
    langs: list[str]
    models: list[KneserNey]
    centre: list[float]
    spread: list[float]
    sharpness: float = 40.0

    def entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the number of its letters."""
        bits, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b, parts, folded in _portions(texts):
            sizes = np.array([len(p) for p in parts])
            codes, uniques = pd.factorize(np.concatenate(parts).view(np.int64))
            cuts = np.cumsum(sizes) - sizes
            for k, model in enumerate(self.models):
                cost = -np.log2(model.prob(uniques.view(np.uint64)))
                bits[a:b, k] = np.add.reduceat(cost[codes], cuts) / sizes
            letters[a:b] = folded
        give_back()
        return bits, letters

    def predict(self, texts) -> pd.DataFrame:
        if not self.langs:
            none = np.array([not (fold(t) != BLANK).any() for t in texts], bool)
            return pd.DataFrame({"lang_pred": ["und"] * len(none), "score": 0.0, "bits": 0.0, "rejected": none})
        bits, letters = self.entropies(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        # short texts say less: their margin counts for less
        scale = self.sharpness * np.minimum(1.0, letters / 100.0)[:, None]
        score = 1.0 / np.exp(-(bits - least[:, None]) * scale).sum(1)
        centre, spread = np.array(self.centre), np.array(self.spread)
        limit = centre[best] + spread[best] * np.sqrt(1.0 + 200.0 / np.maximum(letters, 1))
        none = letters == 0
        return pd.DataFrame(
            {
                "lang_pred": np.where(none, "und", np.array(self.langs, object)[best]),
                "score": np.where(none, 0.0, score),
                "bits": np.where(none, 0.0, least),
                "rejected": none | (least > limit),
            }
        )


def _portions(texts, most: int = 750_000):
    a, parts, letters, size = 0, [], [], 0
    for k, text in enumerate(texts):
        codes = fold(text)
        letters.append(int((codes != BLANK).sum()))
        parts.append(grams(codes) if len(codes) > 1 else grams(np.full(2, BLANK, np.uint16)))
        size += len(parts[-1])
        if size > most:
            yield a, k + 1, parts, letters
            a, parts, letters, size = k + 1, [], [], 0
    if parts:
        yield a, a + len(parts), parts, letters


def _all_grams(own: DataFrame, size: int, most: int = 5_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(gram, n) of all rows of one language, fetched in parts of about ``most`` rows."""
    parts = -(-size // most)
    fetched = [
        own.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).select("gram", "n").toArrow() for k in range(parts)
    ]
    gram, n = (np.concatenate([t[c].to_numpy() for t in fetched]) for c in ("gram", "n"))
    return gram.view(np.uint64), n


def _own_texts(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(lang, sha, m) of the texts of 50 letters or more that ``model`` gives their own language."""

    @F.pandas_udf("struct<lang_pred: string, bits: double, letters: long>")
    def measure(text: pd.Series) -> pd.DataFrame:
        bits, letters = model.entropies(text)
        best = bits.argmin(1)
        return pd.DataFrame(
            {"lang_pred": np.array(model.langs, object)[best], "bits": bits.min(1), "letters": letters}
        )

    # as a deterministic function it would be scored again for the condition, by a second worker a task
    measured = rows.select("lang", F.sha2("text", 256).alias("sha"), measure.asNondeterministic()("text").alias("m"))
    return measured.where("m.lang_pred = lang AND m.letters >= 50")


def fit(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    tolerance: float = 8.0,
    fewest: int = 50,
    required: bool = True,
) -> LanguageModel:
    """Learn from every row of ``labelled``; rows without language or text are ignored.

    Without any other row this raises ValueError or, if not ``required``, gives a model without languages: to it every
    text is ``und`` with score 0, and only texts without a letter are rejected.

    The model holds all n-grams of each language, however rare, so it grows with the corpus (16 bytes for an n-gram
    of each order and for a context, in the driver and in every worker that scores). The rejection
    limit of a language is fitted on all its different texts of 50 letters or more: ``tolerance`` robust standard
    deviations above the median. A language with less than ``fewest`` such texts has no limit, and only its texts without
    a letter are rejected.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInPandas(_count, "lang string, gram long, n long")
    spark = labelled.sparkSession
    with batches_of(spark, TEXT_BATCH):
        totals = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    held = sorted((r["lang"], r["count"]) for r in totals.groupBy("lang").count().collect())  # one row per language
    if not held and not required:
        return LanguageModel([], [], [], [])
    if not held:
        raise ValueError("no labelled text to learn from")
    langs, models = [lang for lang, _ in held], []
    for lang, size in held:
        models.append(KneserNey.fit(*_all_grams(totals.where(F.col("lang") == lang), size)))
    model = LanguageModel(langs, models, [0.0] * len(langs), [np.inf] * len(langs))

    seen = _own_texts(rows, model)
    seen = seen.groupBy("lang", "sha").agg(F.first("m.bits").alias("bits"))  # copies count once
    middle = seen.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("bits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("q")
    )
    with batches_of(spark, TEXT_BATCH):
        limits = middle.where(F.col("n") >= fewest).collect()  # one row per language
    for r in limits:
        k = langs.index(r["lang"])
        low, mid, high = r["q"]
        model.centre[k], model.spread[k] = mid, tolerance * max((high - low) / 1.349, 0.02)
    return model


def predictor(model: LanguageModel):
    """A column function text -> struct(lang_pred, score, bits, rejected); Spark broadcasts the model with it."""

    @F.pandas_udf("struct<lang_pred: string, score: double, bits: double, rejected: boolean>")
    def predict(text: pd.Series) -> pd.DataFrame:
        return model.predict(text)

    return predict


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out``: lang_pred, score, bits, rejected.

    NULL texts and texts without a letter are ``und`` with score 0 and rejected; no other text is ``und`` unless the model has no language. Equal
    texts get equal results; among equally good languages the first in sorted order wins.
    """
    return docs.withColumn(out, predictor(model)(F.col(text_col)))


def remainder(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))
