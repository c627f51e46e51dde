"""The whole job where an operator once did less: recall, calibration, model size, empty tables."""

import numpy as np

import corpus_pipeline
from twinlake.llm import jaccard, langid, quality

PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(n=60, seed=1):
    """Pairs of texts of 80 to 400 words, the second with one to a few words changed."""
    rng = np.random.default_rng(seed)
    texts = {}
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(int(rng.integers(80, 400)))]
        texts[2 * i] = " ".join(words)
        for k in rng.choice(len(words), int(rng.integers(1, 2 + len(words) // 60)), False):
            words[k] = "changed" + str(k)
        texts[2 * i + 1] = " ".join(words)
    base = texts[0].split()
    for i in range(200):  # one large group around one text
        texts[1000 + i] = " ".join(base[: i % len(base)] + ["x" + str(i)] + base[i % len(base) :])
    return texts


def brute(texts, least=0.8):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {k: cut(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in texts}


def test_near_dedup_finds_all_five_word_copies(spark):
    texts = near_copies() | {5000: "", 5001: None, 5002: " \t", 5003: "a b", 5004: "A  b", 5005: "a c"}
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], PIPE)
    want = brute(texts)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in out.collect()} == set(want.values())
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_texts(docs).collect()}
    assert got == want
    assert jaccard.near_texts(docs.where("false")).count() == 0


def test_near_texts_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1500):
        all_ = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = all_[:270], all_[30:]
        met += (jaccard.cells(a) == jaccard.cells(b)).any()
    assert met >= 1490


def speech(seed, kinds, words=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(kinds, 3)) for _ in range(words))


COMMON, RARE = ["pa", "po", "ti", "ra"], ["sch", "ung", "ie", "orn"]


def test_rejection_is_fitted_for_each_language(spark):
    """Beside 9 000 rows of another language, 60 rows of a language still set its limit, and 5 rows set none."""
    for n, limited in ((60, True), (5, False)):
        rows = [(i, speech(i % 300, COMMON), "aa", "s", 1) for i in range(9_000)]
        rows += [(10_000 + i, speech(20_000 + i, RARE), "bb", "s", 1) for i in range(n)]
        rows += [(11_000 + i, rows[9_000][1], "bb", "s", 1) for i in range(100)]  # copies do not count
        model = langid.fit(spark.createDataFrame(rows, PIPE).repartition(4))
        at = model.langs.index("bb")
        assert np.isfinite(model.spread[at]) == limited and np.isfinite(model.spread[model.langs.index("aa")])
        held = [speech(30_000 + i, RARE) for i in range(200)]
        assert not model.predict(held)["rejected"].any()
        if limited:
            bits = model.entropies([r[1] for r in rows[9_000 : 9_000 + n]])[0][:, at]
            assert abs(model.centre[at] - np.median(bits)) < 0.05


def test_model_keeps_rare_grams_of_a_large_alphabet(spark):
    """300 000 different 4-grams of one language, most of them seen once: all are in the model, with their discount."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 1000))) for _ in range(300)]
    rows = [(i, t, "zz", "s", 1) for i, t in enumerate(texts)] + [(i, speech(i, COMMON), "aa", "s", 1) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, PIPE).repartition(4))
    gram, n = np.unique(np.concatenate([langid.grams(langid.fold(t)) for t in texts]), return_counts=True)
    assert len(gram) > 290_000
    got, want = model.models[model.langs.index("zz")], langid.KneserNey.fit(gram, n)
    assert all(np.array_equal(a, b) for a, b in zip(got.codes, want.codes))
    assert all(np.allclose(a, b) for a, b in zip(got.probs, want.probs)) and got.floor == want.floor


def test_empty_and_unlabelled_tables(spark):
    rows = [(1, "some words here", None, "s", 1), (2, "12 !!", None, "s", 1), (3, None, None, "s", 1)]
    unlabelled = spark.createDataFrame(rows, PIPE)
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()] == [1]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(unlabelled, labels, "doc_id", "text", "quality")
    assert [r["score"] for r in quality.scored(unlabelled, model).collect()] == [0.5] * 3
    docs = unlabelled.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""))
        assert docs.count() == 0


def test_training_skips_what_does_not_fit(spark):
    """A text over the byte limit, in whatever place, costs only itself; a repeated id is one row."""
    rows = [(i, ("good words here " if i % 2 else "BUY NOW!! ") * 5, "en", "s", 1) for i in range(60)]
    rows += [(100 + i, "x" * 60_000, "en", "s", 1) for i in range(6)] + [(1, "z" * 500, "en", "s", 1)] * 40
    docs = spark.createDataFrame(rows, PIPE)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, "doc_id", "text", "quality", sample_bytes=50_000)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs.where("doc_id < 60 AND length(text) < 400"), model).collect()}
    assert all((s >= 0.5) == bool(k % 2) for k, s in scores.items()) and len(scores) == 60
    nothing = quality.fit(docs, labels.where("doc_id >= 100"), "doc_id", "text", "quality", sample_bytes=50_000)
    assert [r["score"] for r in quality.scored(docs.limit(2), nothing).collect()] == [0.5] * 2


def test_rows_without_id_are_scanned_once_each(spark):
    """A third of the rows under one NULL id, each text with a secret of its own, seen ones left alone."""
    from twinlake.llm import ledger

    rows = [(None if i % 3 == 0 else i % 7, f"token = value{i:04d}", "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, PIPE)
    found, added = ledger.scan(docs, ledger.empty_ledger(spark))
    assert added.count() == 600 and all(len(r["spans"]) == 1 and r["fresh"] for r in found.collect())
    more = spark.createDataFrame([*rows, *rows[:50], (None, "secret: another1", "en", "s", 1)], PIPE)
    again, fresh = ledger.scan(more, added)
    assert fresh.count() == 1 and sum(r["fresh"] for r in again.collect()) == 1 and again.count() == 651


def test_busy_anchors_are_cut_by_bytes(spark, monkeypatch):
    import plain

    from twinlake.llm import repeats

    monkeypatch.setattr(repeats, "BUSY_BYTES", 200)
    rng = np.random.default_rng(3)
    shared = ["".join(rng.choice(list("abc"), 40)) for _ in range(4)]
    texts = {i: "z" * (30 + i) + shared[i % 4] + "".join(rng.choice(list("abcd"), 20)) for i in range(60)}
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], PIPE)
    out = repeats.remove_repeats(docs, length=20, grams=(8, 16, 20)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == plain.repeats(texts, 20)


def test_scratch_of_a_stage_is_deleted(spark, tmp_path):
    """After a stage only its list of dropped rows is left, and after the run only the stage's own table."""
    from pathlib import Path

    from twinlake.sources.scratch import scope, shared_dir

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in near_copies(10).items()], PIPE).write.parquet(path)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    tables = lambda: set(folder.iterdir()) if folder.exists() else set()
    before = tables()
    with scope(spark) as own:
        out = own.keep(corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), ""))
    assert len(tables() - before) == 1 and out.count() > 0


def test_language_models_are_plain_kneser_ney():
    """Entropies and predictions of the sorted arrays against dictionaries, unseen letters and contexts included."""
    import plain

    kinds = {"aa": COMMON, "bb": RARE, "cc": ["ño", "çé", "ß", "İ", "Ωμ", "x1y", "a--b"]}
    texts = {lang: [speech(i, k) for i in range(30)] for lang, k in kinds.items()}
    models = []
    for lang in kinds:
        gram, n = np.unique(np.concatenate([langid.grams(langid.fold(t)) for t in texts[lang]]), return_counts=True)
        models.append(langid.KneserNey.fit(gram, n))
    model = langid.LanguageModel(list(kinds), models, [0.0] * 3, [np.inf] * 3)
    asked = [speech(500 + i, k) for k in kinds.values() for i in range(10)] + ["", "a", " ?! ", "zzz qqq 你好", "sch" * 50, "Á b\tc"]
    want = np.array([[bits(t) for bits in (plain.kneser_ney(texts[lang]) for lang in kinds)] for t in asked])
    got, _ = model.entropies(asked)
    assert np.allclose(got, want, atol=1e-9)
    assert model.predict(asked)["lang_pred"].tolist()[:30] == [list(kinds)[i] for i in want[:30].argmin(1)]


def test_attention_scores_are_the_plain_ones():
    import plain

    texts = [speech(i, COMMON) + "\n" + speech(i + 1, RARE) if i % 2 else "BUY NOW!! " * 9 + "\n\n" + speech(i, RARE) for i in range(40)]
    model = quality.train(texts, [i % 2 for i in range(40)], epochs=15)
    for text in [*texts[:4], "", "one\ntwo\nthree", "x" * 5000]:
        assert abs(plain.attention(model, text) - model.score([text])[0]) < 1e-4
