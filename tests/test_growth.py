"""Steps whose cost grew faster than their input."""

import re
from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from twinlake.functions.rand import uniform
from twinlake.llm import jaccard, langid
from twinlake.operators import basket, utility
from twinlake.operators.draw import draw_weighted


def test_a_draw_digests_its_key_once_a_row(spark):
    cells = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(3).alias("__n"))
    base = spark.range(50).select("id", (F.col("id") % 2).alias("g"))
    drawn = draw_weighted(base, cells, ["g"], "v", uniform(1, "v", "id"), "v")
    assert drawn.count() == 50 and drawn.where("v % 2 <> g OR v IS NULL").isEmpty()
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    inner = re.search(r"filter\(__runs.*", plan).group(0)
    assert "md5" in plan and "md5" not in inner


def test_calibration_texts_are_scored_once(spark):
    rows = spark.createDataFrame([("de", "der die das " * 9)], "lang string, text string")
    plan = langid._own_texts(rows, langid.LanguageModel([], [], [], []))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_texts_are_found_by_linked_fingerprints(spark, monkeypatch):
    """Without any minimum hash, near copies whose fingerprints differ in at most three bits are linked."""
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{i}" for i in range(400)]}
    a, b = (jaccard.majority(jaccard.shingles(" ".join(texts[k]))) for k in (1, 2))
    assert 0 < (a ^ b).bit_count() <= 3

    def prints_only(size):
        from twinlake.llm.jaccard import majority, shingles

        @F.pandas_udf("print long, cells array<long>")
        def run(text: pd.Series) -> pd.DataFrame:
            prints = [int.from_bytes(majority(shingles(t, size)).to_bytes(8, "little"), "little", signed=True) for t in text]
            return pd.DataFrame({"print": prints, "cells": [[] for _ in prints]})

        return run

    monkeypatch.setattr(jaccard, "_cells", prints_only)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_texts(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_itemsets_of_every_size_and_one_shuffle_by_basket(spark):
    rows = [(b, chr(97 + i), 1) for b in range(60) for i in range(6) if (b * 7 + i * i * 3) % 11 > 2]
    df = spark.createDataFrame(rows, "b long, i string, q int")
    kept = basket.baskets(df, "b", "i", "q")
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    held = {}
    for b, i, _ in rows:
        held.setdefault(b, set()).add(i)
    held = {b: s for b, s in held.items() if len(s) >= 2}
    want = Counter(c for s in held.values() for k in range(1, 7) for c in combinations(sorted(s), k))
    found, n = basket.frequent_itemsets(kept, "b", "i", 0.2)
    assert n == len(held)
    got = {tuple(r["items"]): (r["size"], r["freq"]) for r in found.collect()}
    assert got == {c: (len(c), f) for c, f in want.items() if f >= 0.2 * n} and max(map(len, got)) >= 4


def test_fits_in_many_steps_have_few_tasks(spark, monkeypatch):
    tasks, real = [], utility.classifier

    class Spy:
        def __init__(self, *args, **more):
            self.model = real(*args, **more)

        def fit(self, train):
            tasks.append(train.rdd.getNumPartitions())
            return self.model.fit(train)

    monkeypatch.setattr(utility, "classifier", Spy)
    df = spark.range(400).repartition(8).select("id", (F.col("id") % 20).alias("x"), (1 + (F.col("id") % 20 > 9).cast("int")).alias("y"))
    for model in ("svm", "logreg"):
        assert utility.evaluate(model, df, ["x"], "y", "id").first()["accuracy"] > 0.9
    assert tasks == [1, 1]


def test_mixture_steps_are_spread_over_tasks(spark, monkeypatch):
    """A table read as one part, as a file with one row group is, is fitted in one part for each STEP_ROWS rows."""
    from pyspark.sql import functions as F

    from twinlake.operators import fidelity

    parts = []

    class Spy(fidelity.GaussianMixture):
        def fit(self, rows):
            parts.append((rows.rdd.getNumPartitions(), rows.count()))
            return super().fit(rows)

    monkeypatch.setattr(fidelity, "STEP_ROWS", 100, raising=False)
    monkeypatch.setattr(fidelity, "GaussianMixture", Spy)
    rows = spark.range(950, numPartitions=1).select((F.col("id") % 2 * 50 + F.col("id") % 7).cast("double").alias("x"))
    got = fidelity.mixture_loglik(rows, rows, ["x"], k_candidates=(1, 2), max_iter=5).first()
    assert parts == [(10, 950)] and got["rows"] == 950
