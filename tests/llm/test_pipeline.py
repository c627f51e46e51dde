"""The corpus pipeline, stage by stage, against plain versions."""

from collections import Counter

import plain
import pytest
from test_whole import brute

import corpus_pipeline
from twinlake.llm.refine import LOWER, UPPER

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SMALL)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(df.schema == stages[0].schema for df in stages[1:-1])


def test_language_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = {r["doc_id"] for r in labels.collect()} & set(texts(stages[0]))
    assert clean <= set(texts(stages[1]))


def test_copies_go(stages):
    before, exact, near = (texts(df) for df in stages[1:4])
    last = {}
    for k, t in sorted(before.items()):
        last[(t or "").translate(str.maketrans(UPPER, LOWER))] = k
    assert set(exact) == set(last.values())
    assert set(near) == set(brute(exact).values())


def test_mix_and_packing(spark, stages):
    taken = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert taken and max(taken.values()) <= 2 and set(taken) <= set(texts(stages[3]))
    rows = stages[5].collect()
    starts = Counter((r["doc_id"], r["start"]) for r in rows if r["start"] == 0)
    assert {k: n for (k, _), n in starts.items()} == dict(taken)
    kept = texts(stages[3])
    once = corpus_pipeline.pack_tokens(spark, stages[3], SMALL).collect()
    plain.pieces_hold([tuple(r) for r in once], kept)


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, target string"
    rows = [(i, f"wa bo ci {i % 7} der die das {i}", "de", "s", 1, "x") for i in range(40)]
    rows += [(50, None, None, None, None, None), (51, "", "de", None, 0, "x"), (1, rows[1][1], "de", "s", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL))
    assert docs.count() > 0


def test_long_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Language ID and near-dedup: a batch of many MB fails here."""
    import pandas as pd
    from pyspark.sql import functions as F

    from twinlake.llm import jaccard, langid, workers

    most = 6 << 20
    count, cells = langid._count, jaccard._cells

    def counted(batches):
        def small():
            for pdf in batches:
                assert pdf["text"].str.len().sum() < most
                yield pdf

        return count(small())

    def predictor(model):
        @F.pandas_udf("struct<rejected: boolean>")
        def run(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"rejected": [bool(text.str.len().sum() >= most)] * len(text)})

        return run

    def checked(size):
        inner = cells(size)
        plain_run = inner.func

        @F.pandas_udf(inner.returnType)
        def run(text: pd.Series) -> pd.DataFrame:
            assert text.str.len().sum() < most
            return plain_run(text)

        return run

    docs = spark.range(6000, numPartitions=1).selectExpr("id AS doc_id", "concat(id % 5000, ' ', repeat('yz', 1500)) AS text", "'aa' AS lang")
    docs = corpus_pipeline.materialize(docs)
    before = spark.conf.get(workers.BATCH_BYTES)
    monkeypatch.setattr(langid, "_count", counted)
    monkeypatch.setattr(langid, "predictor", predictor)
    monkeypatch.setattr(jaccard, "_cells", checked)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 6000
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 5000
    assert spark.conf.get(workers.BATCH_BYTES) == before


def test_pieces_are_cut_without_python(spark):
    words = "one two three, four five! "
    texts = {1: words * 3000, 2: "", 3: None, 4: "a b c", 5: words * 700, 6: "Ünï 漢字 \U0001f600 x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    cut = corpus_pipeline.pack_tokens(spark, docs, "")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "Python" not in plan
    rows = [tuple(r) for r in cut.collect()]
    assert sum(r[0] == 1 for r in rows) > 4
    plain.pieces_hold(rows, texts)
