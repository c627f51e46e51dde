"""Encoding, splitting, scoring and training on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SEED, Family, table, u_sql
from twinlake.functions.rand import uniform
from twinlake.operators import utility as ut
from twinlake.operators.aggregate import rounded

family = Family()
add = family.add


def _codes_sql(src, col, order):
    return (
        f"(SELECT v, row_number() OVER (ORDER BY o) AS code FROM (SELECT {col} AS v, min({order}) AS o FROM {src} GROUP BY 1))"
    )


@add(
    "ml_ordinal_encode",
    f"""WITH src AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority FROM orders)
        SELECT o_orderkey, CAST(a.code AS INTEGER) AS status, CAST(b.code AS INTEGER) AS priority FROM src
        JOIN {_codes_sql('src', 'status', 'o_orderkey')} a ON a.v IS NOT DISTINCT FROM status
        JOIN {_codes_sql('src', 'priority', 'o_orderkey')} b ON b.v = priority""",
)
def _(spark, d):
    src = table(spark, d, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return ut.ordinal_encode(src, ["status", "priority"], ["o_orderkey"])


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")


LABELLED = "doc AS (SELECT doc_id, quality, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"
FEATURES = ["lang", "source", "n_chars"]


@add(
    "ml_prepare_features",
    f"""WITH {LABELLED}, src AS (SELECT * REPLACE (CASE WHEN {u_sql('gap', 'doc_id')} < 0.1 THEN NULL ELSE n_chars END
            AS n_chars) FROM doc WHERE lang IN (SELECT lang FROM doc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 99))
        SELECT doc_id, CAST(l.code AS INTEGER) AS lang, CAST(s.code AS INTEGER) AS source, n_chars,
               CAST(q.code AS INTEGER) AS quality FROM src
        JOIN {_codes_sql('src', 'lang', 'doc_id')} l ON l.v = lang
        JOIN {_codes_sql('src', 'source', 'doc_id')} s ON s.v = source
        JOIN {_codes_sql('src', 'quality', 'doc_id')} q ON q.v = quality WHERE n_chars IS NOT NULL""",
)
def _(spark, d):
    gap = uniform(SEED, "gap", "doc_id") < 0.1
    df = labelled(spark, d).withColumn("n_chars", F.when(~gap, F.col("n_chars")))
    return ut.prepare_features(
        df, FEATURES, "quality", ["lang", "source", "quality"], ["doc_id"], target_values=[0, 1]
    )


@add("ml_split", f"SELECT doc_id, {u_sql('split', 'doc_id')} < 0.3 AS is_test FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ut.is_test("doc_id", 0.3, SEED).alias("is_test"))


_SCORED = f"""p AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
    CASE WHEN {u_sql('guess', 'o_orderkey')} < 0.6 THEN CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END
         WHEN {u_sql('guess', 'o_orderkey')} < 0.8 THEN 0 ELSE 1 END AS prediction FROM orders)"""


@add(
    "ml_scores",
    f"""WITH {_SCORED}, c AS (SELECT DISTINCT label AS c FROM p), m AS (SELECT c,
          (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS called,
          (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM c)
        SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
               round(sum(support * (2.0::DOUBLE * tp / (support + called))) / sum(support), 6) AS f1 FROM m""",
)
def _(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    u = uniform(SEED, "guess", "o_orderkey")
    guess = F.when(u < 0.6, label).when(u < 0.8, 0).otherwise(1)
    pred = table(spark, d, "orders").select(label.alias("label"), guess.alias("prediction"))
    return rounded(ut.classification_scores(pred))


def _utility(model):
    def run(spark, d):
        df = ut.prepare_features(labelled(spark, d), FEATURES, "quality", ["lang", "source", "quality"], ["doc_id"])
        return rounded(ut.evaluate(model, df, FEATURES, "quality", "doc_id", categorical=["lang", "source"]))

    return run


for _model in ut.MODELS:
    add(f"ml_utility_{_model}")(_utility(_model))


@add("ml_utility_multiclass")
def _(spark, d):
    o = table(spark, d, "orders")
    feats = ["o_totalprice", "o_orderpriority"]
    df = ut.prepare_features(o, feats, "o_orderstatus", ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])
    return rounded(ut.evaluate("svm", df, feats, "o_orderstatus", "o_orderkey", categorical=["o_orderpriority"]))


@add("ml_utility_report")
def _(spark, d):
    orig = labelled(spark, d)
    noise = uniform(SEED, "noise", "doc_id")
    other = orig.withColumns(
        {
            "n_chars": (F.col("n_chars") * (0.5 + noise)).cast("long"),
            "lang": F.when(noise < 0.2, "xx").otherwise(F.col("lang")),
        }
    )
    return rounded(
        ut.utility_report(
            orig, other, ["quality"], FEATURES, ["lang", "source"], ["doc_id"]
        )
    )
