"""Spelling variants, BPE by rank arrays and source divergence on odd rows, against plain versions and libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinlake.llm import divergence, packing, rankbpe, spelling

VOCABULARY = "word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, ids string, decoded string, word string, n long, item string, term string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1, "i", "t") for r in rows], DOCS)


PIECES = [*"abcABC'sStTdD!?.,-_<|>09 \t\n\x0b\x1c\x1f\x85\xa0", *" 　́̇İıſßΣσςéÉÅÅﬁ你あ한가‍﻿\x00\x7f²½Ⅷ٣ªµº×÷ÿÀ", "\U0001f600"]
PIECES += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'ll", "'re", "the", "word"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


LONG = ["a" * 3000, "ab" * 5000, "é" * 2000, "x " * 900, "the" * 700 + "!" * 3000, "\U0001f600" * 900]


# 12: BPE


def test_rank_arrays_encode_like_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    coder = rankbpe.RankBpe(public_tokenizers.path(VOCABULARY))
    texts = odd_texts(10_000) + LONG + [chr(c) + "b" for c in range(1, 0x3000)]
    got = coder.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got.to_pylist() == want
    assert coder.decode(got).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in want]


def test_scanning_and_linked_parts_merge_alike(monkeypatch):
    coder = rankbpe.RankBpe(public_tokenizers.path(VOCABULARY))
    rng = random.Random(2)
    for _ in range(300):
        parts = [coder.first[rng.choice("abcdefgth")] for _ in range(rng.randint(1, 60))]
        scanned = coder.merged(list(parts))
        monkeypatch.setattr(rankbpe, "SHORT", 0)
        assert coder.merged(list(parts)) == scanned
        monkeypatch.undo()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(rankbpe, "REMEMBERED", 50)
    coder = rankbpe.RankBpe(public_tokenizers.path(VOCABULARY))
    texts = odd_texts(400)
    parts = [coder.encode(pa.array(texts[i : i + 20])).to_pylist() for i in range(0, 400, 20)]
    assert sum(parts, []) == rankbpe.RankBpe(public_tokenizers.path(VOCABULARY)).encode(pa.array(texts)).to_pylist()


def test_encode_and_decode_rows(spark):
    rows = [(1, None, "a", "s"), (2, "", "a", "s"), (3, " \t\n", "a", "s"), (None, "no id", "a", "s"), (4, LONG[1], "a", "s"), (4, LONG[1], "a", "s")]
    coded = rankbpe.encode(docs(spark, rows))
    out = rankbpe.decode(coded).collect()
    assert coded.columns == ["doc_id", "ids"] and len(out) == len(rows)
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _, _ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in out)
    given = spark.createDataFrame([(None, "c"), ([], "c"), ([320, 10**8, -1], "c")], "ids array<int>, decoded string")
    assert [r["decoded"] for r in rankbpe.decode(given).collect()] == [None, "", library.decode([320], skip_special_tokens=False)]
    assert rankbpe.decode(rankbpe.encode(docs(spark, []))).count() == 0


def test_packing_encodes_odd_texts(monkeypatch):
    """The encoder of the packing stage: 10 000 odd texts, while it forgets what it knew."""
    monkeypatch.setattr(packing, "KEPT_PIECES", 5_000)
    coder = packing.WordIds(public_tokenizers.path(VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    texts = odd_texts(10_000, seed=3) + ["İ. x"] + LONG
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, n = coder.encode(pa.array(part))
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


# 13: spelling


def spelled(spark, rows, **how):
    out = spelling.variant_groups(docs(spark, rows), **how).collect()
    assert len(out) == len({r["word"] for r in out})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}


def invented(seed, letters, n=1500, size=(4, 9)):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(*size))) for _ in range(n // 3)]
    texts = []
    for i in range(60):
        picked = rng.choice(words, 200) if i % 2 else rng.choice(words[:40], 200)
        texts.append((i, " ".join(w[1:] if rng.random() < 0.05 else w for w in picked), "a", "s"))
    return texts


@pytest.mark.parametrize("node", [16_384, 20])
@pytest.mark.parametrize("letters", ["abc", "abcdefgéÿÀ×", "eainrst"])
def test_spelling_groups(spark, monkeypatch, letters, node):
    """Few letters put many words into one leaf; small nodes open the trie level by level and split its visitors."""
    monkeypatch.setattr(spelling.near_words, "__defaults__", (node, 50 if node == 20 else 65_536))
    rows = invented(len(letters), letters)
    assert spelled(spark, rows) == plain.spelling([r[:2] for r in rows])


def test_spelling_odd_rows(spark):
    rows = [(None, "Words words WORDS wordz wordz wordz", "a", "s"), (1, None, "a", "s"), (2, "", "a", "s"), (3, "words" * 400 + " ", "a", "s")]
    rows += [(4, ("q" * 3000 + " ") * 3 + ("q" * 2999 + " ") * 9, "a", "s"), (5, "wordés wordés wordés ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ àéîõü", "a", "s")]
    rows += [rows[4]] * 2
    got = spelled(spark, rows)
    assert got == plain.spelling([r[:2] for r in rows])
    assert got["q" * 3000][0] == "q" * 2999 and "àéîõü" not in got
    assert spelled(spark, [(1, "one two", "a", "s")]) == {} and spelled(spark, []) == {}


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    roots = spelling.with_roots(spark.createDataFrame(chain, "word string, form string"))
    assert {r["word"]: r["root"] for r in roots.collect()} == {w: "w40" for w, _ in chain}


# 11: divergence


def plain_divergence(rows, least=3, k=200):
    terms = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in (t or "")).translate({c: " " for c in range(128) if not chr(c).isalpha()}).split(" ") if w]
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        found = terms(text)
        counts[group].update(found)
        seen[group[0]].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        mine = sorted(s for l, s in groups if l == lang)
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = {t: sum(counts[lang, s][t] for s in mine) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in mine}, share(total)
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:k])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)}
    return out


def diverged(spark, rows, **how):
    out = [tuple(r) for r in divergence.divergence(docs(spark, rows), **how).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize(("part", "k"), [(8_192, 200), (16, 5), (16, 200)])
def test_divergence(spark, monkeypatch, part, k):
    monkeypatch.setattr(divergence.skybands, "__defaults__", (part,))
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 4))) for _ in range(300)]
    rows = []
    for i in range(200):
        favoured = words[(i % 5) * 30 : (i % 5) * 30 + 60]
        rows.append((i, " ".join(rng.choice(favoured if rng.random() < 0.7 else words, 40)), "ab"[i % 2], f"s{i % 5}" if i % 11 else None))
    assert diverged(spark, rows, k=k) == plain_divergence(rows, k=k)


def test_divergence_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "a", "s"), (2, "12 !", "b", "t"), (3, "Été été ÉTÉ naïve", "b", "u"), (4, "a " * 50_000, "b", "t")]
    rows += [(5, "A b", "b", "u")] * 3 + [(6, "A b", "b", None)]
    assert diverged(spark, rows) == plain_divergence(rows)
    assert ("b", "t", "pair", "", 0, 1) not in diverged(spark, rows)
    assert diverged(spark, []) == set()
    lonely = diverged(spark, [(1, "x", "a", "s"), (2, "y", "a", "t")])  # no term in three documents
    assert lonely == {("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)}


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(5)
    high, low, order = rng.integers(0, 30, 900), rng.integers(0, 30, 900), rng.permutation(900)
    for k in (1, 7, 200):
        want = [
            i for i in range(900) if ((high >= high[i]) & (low <= low[i]) & (order < order[i])).sum() < k
        ]
        assert sorted(divergence.survivors(high, low, order, k).tolist()) == want


def test_share_is_exact(spark):
    pairs = [(1, 3), (2, 3), (7 * 10**14, 9 * 10**14 + 1), (10**15, 10**15), (1, 10**15)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.expr(divergence.share_sql("a", "b")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * r["a"] // r["b"] for r in rows.collect())


def test_digests_of_the_queries(spark):
    from twinlake.llm.queries import family

    rows = {r["doc_id"]: r for r in family.queries["op12_rank_bpe"](spark, "/root/testdata/sf0.001").collect()}
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows.pop(r["doc_id"])
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not rows
