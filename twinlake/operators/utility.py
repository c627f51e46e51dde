"""Predictive utility: train on each side, compare accuracy and F1."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.rand import uniform
from twinlake.functions.values import texts_of
from twinlake.operators.rank import global_rank
from twinlake.sources.scratch import materialize

MODELS = ("tree", "svm", "logreg", "forest")
#: Rows of one task in a fit that runs a job for each of its up to 1000 steps.
STEP_ROWS = 50_000


def ordinal_codes(df: DataFrame, cols: list[str], order: list[str], like: DataFrame | None = None) -> DataFrame:
    """Codes 1..n per column in order of first appearance: ``column, value, code``; NULL is a category.

    ``order`` must be unique per row. ``like`` is the table that is to get the same codes, if its types may differ.
    """
    first = F.struct(*[F.col(c) for c in order]).alias("__o")
    texts = texts_of(df, df if like is None else like, cols)
    pairs = [F.struct(F.lit(c).alias("column"), texts[c].alias("value")) for c in cols]
    long = df.select(first, F.inline(F.array(*pairs)))
    seen = long.groupBy("column", "value").agg(F.min("__o").alias("__o"))
    ranked, _ = global_rank(seen, "column", "__o", name="__r")
    ranked = materialize(ranked)
    start = ranked.groupBy("column").agg(F.min("__r").alias("__first"))
    coded = ranked.join(start, "column")
    return materialize(coded.select("column", "value", (F.col("__r") - F.col("__first") + 1).cast("int").alias("code")))


def apply_codes(df: DataFrame, codes: DataFrame, cols: list[str], like: DataFrame | None = None) -> DataFrame:
    """Replace each column by its code; values without a code become NULL. ``like`` is the table the codes are of."""
    order, texts = df.columns, texts_of(df, df if like is None else like, cols)
    for c in cols:
        mine = codes.filter(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__k"))
        joined = df.join(mine, texts[c].eqNullSafe(F.col("__v")), "left")
        df = joined.withColumn(c, F.col("__k")).drop("__v", "__k")
    return df.select(*order)


def ordinal_encode(
    df: DataFrame, cols: list[str], order: list[str], codes: DataFrame | None = None, like: DataFrame | None = None
) -> DataFrame:
    return apply_codes(df, ordinal_codes(df, cols, order, like) if codes is None else codes, cols, like)


def prepare_features(
    df: DataFrame,
    features: list[str],
    target: str,
    categorical: list[str],
    order: list[str],
    target_values: list | None = None,
    codes: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    like: DataFrame | None = None,
) -> DataFrame:
    """Rows ready for a classifier: wanted target classes, encoded categories, nothing missing.

    Pass the original's ``codes`` to read another table the same way; values the
    original never had then become NULL and leave. ``like`` is the table on the
    other side: numbers there and numeric text here then have the same code.
    """
    rows = df if target_values is None else df.filter(F.col(target).isin(*target_values))
    used = list(dict.fromkeys([*keep, *order, *features, target]))
    rows = rows.select(*used)
    encoded = ordinal_encode(rows, categorical, order, codes, like)
    return encoded.dropna(subset=[*features, target])


def is_test(key, share: float = 0.3, seed=1) -> Column:
    """Reproducible split: a pure function of the row key, the same under any partitioning."""
    keys = [key] if isinstance(key, str) else list(key)
    return uniform(seed, "split", *keys) < share


def split(df: DataFrame, key, share: float = 0.3, seed=1) -> tuple[DataFrame, DataFrame]:
    flagged = is_test(key, share, seed)
    return df.filter(~flagged), df.filter(flagged)


def classifier(name: str, classes: int, max_codes: int, rows: int, seed: int = 1, bins: int = 32, svm_iterations: int = 1000):
    """``bins`` is the number of split candidates of a numeric feature; categorical codes raise it to their number."""
    # a penalty of 1/rows is the unit-strength penalty on the summed loss
    penalty = 1.0 / max(rows, 1)
    if name == "tree":
        return DecisionTreeClassifier(impurity="entropy", maxDepth=3, maxBins=max(bins, max_codes), seed=seed)
    if name == "forest":
        return RandomForestClassifier(numTrees=100, maxBins=max(bins, max_codes), seed=seed)
    if name == "logreg":
        return LogisticRegression(maxIter=1000, regParam=penalty)
    if name == "svm":
        svm = LinearSVC(maxIter=svm_iterations, regParam=penalty, tol=1e-4)
        return svm if classes <= 2 else OneVsRest(classifier=svm)
    raise ValueError(f"unknown model {name!r}")


def classification_scores(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows, accuracy and support-weighted F1; both NULL with fewer than two classes."""
    cells = pred.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    per_class = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("l").alias("c"), F.col("n").alias("support"), zero.alias("called"), hit.alias("tp")),
                F.struct(F.col("p").alias("c"), zero.alias("support"), F.col("n").alias("called"), zero.alias("tp")),
            )
        )
    ).groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    sums = per_class.agg(
        F.sum("support").alias("rows"),
        F.sum("tp").alias("tp"),
        F.sum(F.col("support") * f1).alias("f"),
        F.sum((F.col("support") > 0).cast("int")).alias("classes"),
    )
    enough = F.col("classes") >= 2
    return sums.select(
        "rows",
        F.when(enough, F.col("tp") / F.col("rows")).alias("accuracy"),
        F.when(enough, F.col("f") / F.col("rows")).alias("f1"),
    )


def stepped(train: DataFrame, rows: int) -> DataFrame:
    """``train`` in one partition for each STEP_ROWS rows, or as many as it has if they are fewer."""
    return train.coalesce(max(1, -(-rows // STEP_ROWS))).persist()


def evaluate(
    model: str,
    prepared: DataFrame,
    features: list[str],
    target: str,
    key,
    seed: int = 1,
    share: float = 0.3,
    categorical: list[str] | None = None,
) -> DataFrame:
    """Train on 70 %, score on the rest; ``target`` and the ``categorical`` features hold codes 1..n."""
    spark = prepared.sparkSession
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(
        prepared.withColumn("label", F.col(target).cast("double") - 1)
    )
    keys = [key] if isinstance(key, str) else list(key)
    rows = rows.select(*keys, "features", "label")
    train, test = split(rows, key, share, seed)
    whole = train = train.persist()
    try:
        seen = train.agg(F.count_distinct("label"), F.max("label"), F.count(F.lit(1))).first()
        if model in ("svm", "logreg"):
            # hundreds of short jobs: each has as many tasks as the rows need, not as the cluster has cores
            train = stepped(train, seen[2])
        if seen[0] < 2:
            return spark.createDataFrame([(None, None, None)], "rows bigint, accuracy double, f1 double")
        coded = [c for c in categorical or [] if c in features]
        widest = 0
        if coded:
            widest = int(max(c or 0 for c in prepared.agg(*[F.max(F.col(c)) for c in coded]).first())) + 1
        fitted = classifier(model, int(seen[1]) + 1, widest, seen[2], seed).fit(train)
    finally:
        train.unpersist()
        whole.unpersist()
    return classification_scores(fitted.transform(test))


def utility_report(
    orig: DataFrame,
    other: DataFrame,
    targets: list[str],
    features: list[str],
    categorical: list[str],
    order: list[str],
    features_other: list[str] | None = None,
    target_values: list | None = None,
    share_codes: bool = True,
    models=MODELS,
    seed: int = 1,
) -> DataFrame:
    """Accuracy and F1 of every model on both sides: ``target, model, side, metric, value``.

    With ``share_codes`` the other side uses the original's codes (synthetic
    tables); without, each side has its own (anonymised tables).
    """
    parts = []
    for target in targets:
        coded = list(dict.fromkeys([*[c for c in categorical if c in features], target]))
        base = orig if target_values is None else orig.filter(F.col(target).isin(*target_values))
        codes = ordinal_codes(base, coded, order, other if share_codes else None)
        for side, df, feats in (("original", orig, features), ("other", other, features_other or features)):
            mine = list(dict.fromkeys([*[c for c in categorical if c in feats], target]))
            use = codes if side == "original" or share_codes else None
            like = (other if side == "original" else orig) if share_codes else None
            prepared = materialize(prepare_features(df, feats, target, mine, order, target_values, use, like=like))
            for model in models:
                scores = evaluate(model, prepared, feats, target, order, seed, categorical=mine)
                parts.append(
                    scores.select(
                        F.lit(target).alias("target"),
                        F.lit(model).alias("model"),
                        F.lit(side).alias("side"),
                        F.inline(
                            F.array(
                                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                                F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")),
                            )
                        ),
                    )
                )
    return reduce(DataFrame.unionByName, parts)
