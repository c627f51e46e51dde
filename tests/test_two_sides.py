"""Values that two files hold in different types, texts with line breaks, rare rules and long itemsets."""

import pytest
from pyspark.sql import functions as F

from twinlake.functions.values import value_text
from twinlake.operators import basket, clean, constraints, crosstab, fidelity, leakage, pseudonym, synthesize, utility
from twinlake.plans.examples import STATE_PREFIXES
from twinlake.sources import tabular


def test_value_text(spark):
    df = spark.sql("SELECT 34L AS l, 34.0D AS d, 34.00BD AS e, -0.0D AS z, 576460752303423489L AS big, DATE'2020-01-02' AS day, TIMESTAMP'2020-01-02 00:00:00' AS ts, 0.5D AS half")
    row = df.select(*[value_text(df, c).alias(c) for c in df.columns]).first().asDict()
    assert row == {"l": "34", "d": "34", "e": "34", "z": "0", "big": "576460752303423489", "day": "2020-01-02", "ts": "2020-01-02", "half": "0.5"}


def test_leaks_across_types(spark):
    o = spark.sql("SELECT id AS age, concat('n', id) AS name FROM range(30, 40)")
    s = o.select(F.col("age").cast("double"), "name")
    report = leakage.leak_report(o, s, [["age"], ["age", "name"]]).collect()
    assert [r["matched"] for r in report] == [10, 10]
    assert leakage.pii_leak(o, s, ["age"]).where("age_in_original").count() == 10
    texts = s.withColumn("age", F.col("age").cast("int").cast("string"))
    marked = leakage.pii_leak(o, texts, ["age", "name"])
    assert marked.where("`age+name_in_original`").count() == 10 and marked.columns[:2] == ["age", "name"]


def test_metrics_of_long_integers_and_zeros(spark):
    big = 1 << 59
    o = spark.range(big, big + 51).select(F.col("id").alias("k"), F.lit(0.0).alias("z"))
    s = spark.range(big, big + 1).select(F.col("id").alias("k"), F.lit(-0.0).alias("z"))
    coverage = {r["column"]: r["value"] for r in fidelity.category_coverage(o, s, ["k", "z"]).collect()}
    assert abs(coverage["k"] - 1 / 51) < 1e-12 and coverage["z"] == 1
    assert fidelity.tv_complement(o, s, ["z"]).first()["value"] == 1


def test_codes_across_types(spark):
    o = spark.createDataFrame([(1, 5, 0), (2, 6, 1)], "id long, f long, t int")
    s = o.withColumn("f", F.col("f").cast("double"))
    codes = utility.ordinal_codes(o, ["f", "t"], ["id"])
    assert utility.prepare_features(s, ["f"], "t", ["f", "t"], ["id"], codes=codes).count() == 2


def test_csv_with_line_breaks_and_codes(spark, tmp_path):
    rows = [(1, "x\ny", "1d", 1.5), (2, 'say "a;b"\n\n', "2f", 2.25), (3, "plain", "3d", -3.0)]
    df = spark.createDataFrame(rows, "id long, note string, code string, v double")
    path = str(tmp_path / "data" / "one.csv")
    tabular.write_csv(df, path)
    back = tabular.read_csv(spark, path)
    assert back.dtypes == [("id", "bigint"), ("note", "string"), ("code", "string"), ("v", "double")]
    assert sorted(map(tuple, back.collect())) == rows
    nested = tmp_path / "data" / "part.csv" / "data"
    nested.mkdir(parents=True)
    (nested / "one.csv").write_text("a;b\n1;2\n")
    found = {r["dataset"] for r in tabular.dataset_files(spark, str(tmp_path / "data")).collect()}
    assert found == {"one", "part"}


def test_delimiter_of_a_late_section(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b;c\n" * 3 + "a;b\n" * 5000)
    assert tabular.detect_delimiter(spark, str(tmp_path / "late.csv")) == ";"


def test_rare_rules_are_met(spark):
    df = spark.range(2000).select(F.when(F.col("id") == 7, "rare").otherwise("usual").alias("kind"))
    model = synthesize.fit(df, ["kind"])
    got = synthesize.sample_valid(model, spark, 100, [constraints.RowConstraint("kind = 'rare'", "rare")], 3)
    assert got.count() == 100 and got.where("kind <> 'rare'").count() == 0


@pytest.mark.parametrize("size", [3, 14])
def test_rules_of_all_splits(spark, size):
    items = spark.range(1).select(F.expr(f"transform(sequence(1, {size}), x -> cast(x AS string))").alias("items"))
    sets = items.select(F.explode(F.expr(f"transform(sequence(1, {2**size - 1}), m -> array_sort(filter(items, (x, k) -> (shiftright(m, k) & 1) = 1)))")).alias("items"))
    sets = sets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.lit(0.5).alias("support"))
    top = sets.where(F.col("size") == size).unionByName(sets.where(F.col("size") < size).withColumn("size", F.lit(1)))
    assert basket.association_rules(top).count() == 2**size - 2


def test_ties_gaps_and_width(spark):
    df = spark.createDataFrame([(9, 1), (10, 2), (None, 3), (9, 4), (10, 5)], "v long, id long")
    assert clean.impute(df, ["v"]).where("id = 3").first()["v"] == 9
    mapping = pseudonym.pseudonym_map(spark.range(400).select(F.col("id").alias("k")), "k", 5).toPandas()
    gaps = ((mapping["pseudonym"] - 1) % 5).to_numpy()[mapping["pseudonym"].argsort().to_numpy()]
    assert set(gaps[:50]) == {0, 1, 2, 3} and mapping["pseudonym"].is_unique
    wide = crosstab.crosstab(spark.range(6000).select((F.col("id") % 2).alias("r"), "id"), "r", ["id"], "wide")
    assert len(wide.columns) == 6001
    assert len(STATE_PREFIXES) == 9
