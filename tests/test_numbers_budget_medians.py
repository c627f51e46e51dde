"""Numbers of several types, hot tuples in marker joins, medians by selection, private groups and budgets, scratch scopes."""

import math
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinlake.functions.values import decimal_text, value_text
from twinlake.operators import clean, constraints, dp, fidelity, joins, leakage, synthesize, utility
from twinlake.operators.budget import Budget, BudgetExceeded
from twinlake.sources.scratch import materialize, scope, shared_dir

FORMS = {
    "+34": "34", "34.0": "34", "034": "34", "-0.00": "0", ".5": "0.5", "5.": "5", "-.5": "-0.5", "1e-4": "0.0001", "1E+3": "1000",
    "-12.50E-2": "-0.125", "0": "0", "000.100": "0.1", "0e5": "0", "2.50000005E7": "25000000.5", "9.1E15": "9100000000000000",
    "100": "100", "123456789012345678901234567890.50": "123456789012345678901234567890.5", "4.9E-324": "0." + "0" * 323 + "49",
}


def test_decimal_text(spark):
    rows = spark.createDataFrame([(t,) for t in FORMS], "t string").select("t", decimal_text(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in rows.collect()} == FORMS


def test_text_is_a_number_only_beside_numbers(spark):
    df = spark.sql("SELECT '007' AS t, double('NaN') AS n, -double('Infinity') AS i, 0.1F AS f, CAST(NULL AS double) AS z")
    shown = lambda numeric: df.select(*[value_text(df, c, numeric).alias(c) for c in df.columns]).first().asDict()
    assert shown(False) == {"t": "007", "n": "NaN", "i": "-Infinity", "f": "0.1", "z": None}
    assert shown(True)["t"] == "7"


@pytest.mark.parametrize("kind", ["decimal(30,6)", "string", "double"])
def test_equal_numbers_meet_whatever_their_type(spark, kind):
    values = [0.0001, 25000000.5, 9.1e15, -3.0, 0.0]
    o = spark.createDataFrame([(v,) for v in values], "v double")
    s = o.select(F.col("v").cast(kind).alias("v")) if kind != "string" else spark.createDataFrame([(repr(v),) for v in values], "v string")
    assert leakage.leak_report(o, s, [["v"]]).first()["matched"] == len(values)
    assert leakage.leak_report(s, o, [["v"]]).first()["matched"] == len(values)
    assert leakage.pii_leak(o, s, ["v"]).where("v_in_original").count() == len(values)
    assert fidelity.category_coverage(o, s, ["v"]).first()["value"] == 1
    assert fidelity.tv_complement(o, s, ["v"]).first()["value"] == 1
    a, b = (df.withColumn("k", F.monotonically_increasing_id()) for df in (o, s))
    codes = utility.ordinal_codes(a, ["v"], ["k"], like=b)
    assert utility.prepare_features(b, [], "v", ["v"], ["k"], codes=codes, like=a).count() == len(values)


def test_texts_that_only_look_like_numbers_stay_apart(spark):
    o = spark.createDataFrame([("034",), ("1e3",)], "v string")
    s = spark.createDataFrame([("34",), ("1000",)], "v string")
    assert leakage.leak_report(o, s, [["v"]]).first()["matched"] == 0


def hot_table(spark):
    """Nine rows in ten hold one tuple, NULL is frequent as well."""
    kind = F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id")))
    return spark.range(0, 20_000, 1, 8).select("id", kind.alias("a"), F.when(kind == "hot", 1).otherwise(F.col("id") % 3).alias("b"))


def test_hot_tuples_are_answered_apart(spark):
    s = hot_table(spark)
    o = spark.createDataFrame([("hot", 1), (None, 0), ("v9", 0), ("v19", 1), ("v29", 2), ("x", 1)], "a string, b long")
    heavy = joins.heavy_tuples(s, [["a", "b"], ["a"]], share=100, least=200)
    assert {tuple(r) for r in heavy["a", "b"].collect()} == {("hot", 1), (None, 0), (None, 1), (None, 2)}
    assert {tuple(r) for r in heavy["a",].collect()} == {("hot",), (None,)}
    for cols in (["a", "b"], ["a"]):
        apart = joins.mark_exists(s, o, cols, "seen", heavy[tuple(cols)])
        plain = joins.mark_exists(s, o, cols, "seen")
        assert apart.columns == plain.columns == [*s.columns, "seen"]
        assert sorted(map(str, apart.collect())) == sorted(map(str, plain.collect()))
    assert joins.heavy_tuples(s, [["a"]]) == {}


def test_no_task_gets_the_rows_of_a_hot_tuple(spark):
    """Rows per reduce task of the join that is left, without adaptive repair."""
    s = hot_table(spark)
    o = s.select("a", "b").where("id % 7 = 0")
    heavy = joins.heavy_tuples(s, [["a", "b"]], share=100, least=200)["a", "b"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = joins.mark_exists(s, o, ["a", "b"], "seen", heavy)
        cold = marked.join(heavy.withColumnsRenamed({"a": "x", "b": "y"}), (F.col("a").eqNullSafe(F.col("x"))) & (F.col("b").eqNullSafe(F.col("y"))), "left_anti")
        sizes = [r["count"] for r in marked.groupBy(F.spark_partition_id()).count().collect()]
        assert marked.count() == 20_000 and cold.count() == 2_000
        # the hot rows stay in their input partitions; the rest is dealt out evenly
        assert max(sizes) < 20_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


COLUMNS = {
    "even": [float(i) for i in range(5000)],
    "ties": [float(i % 3) for i in range(5001)],
    "one": [7.0] * 10,
    "wide": [10.0**i * (-1) ** i for i in range(-150, 151)],
    "two": [1.0, 3.0],
    "infinite": [float("inf")] * 6 + [1.0] * 3,
    "none": [],
}


def test_medians_by_selection(spark):
    n = max(map(len, COLUMNS.values()))
    rows = [[v[i] if i < len(v) else None for v in COLUMNS.values()] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS)).repartition(7)
    got = {r["column"]: r["m"] for r in fidelity.medians({"m": df}, list(COLUMNS)).collect()}
    assert {c: m for c, m in got.items() if m is not None} == {c: statistics.median(v) for c, v in COLUMNS.items() if v}


def test_a_bracket_that_misses_is_opened(spark):
    long = spark.range(1001).select(F.lit("s").alias("side"), F.lit("c").alias("column"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    for near in ([0.0, 10.0], [900.0, 950.0], [500.0, 500.0], None):
        assert fidelity._selected(long, {("s", "c"): near}).first()["quantile"] == 500


def test_recode_to_values_of_several_kinds(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: r["v"] for r in clean.recode(df.withColumn("v", F.col("k")), "v", {"a": "x", "b": 1.5}).collect()}
    assert got == {"a": "x", "b": "1.5", "c": None}
    long = {f"k{i}": i for i in range(300)} | {"a": "x", "b": 1.5}
    assert {r["k"]: r["v"] for r in clean.recode(df.withColumn("v", F.col("k")), "v", long).collect()} == got


def test_rare_groups_stay_hidden(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1990, F.col("id") % 2).otherwise(F.col("id")).alias("g"))
    for seed in range(15):
        shown = {r["g"]: r["dp_count"] for r in dp.dp_group_counts(df, ["g"], 1.0, 1e-6, seed).collect()}
        assert set(shown) == {0, 1} and all(abs(n - 995) < 30 for n in shown.values())
    # a group of one passes about as often as delta says
    alone = spark.range(4000).select(F.col("id").alias("g"))
    shown = dp.dp_group_counts(alone, ["g"], 1.0, 0.01, 3).count()
    assert 15 < shown < 75
    assert abs(dp.group_threshold(1.0, 0.01) - (1 + math.log(50))) < 1e-12
    with pytest.raises(ValueError):
        dp.dp_group_counts(df, ["g"], 1.0, 0.7, 1)


def test_budget_refuses_what_exceeds_it(spark, tmp_path):
    budget = Budget(spark, str(tmp_path / "ledger"), epsilon=1.0, delta=1e-5)
    assert budget.spend({"a": 0.1, "b": 0.3}) == [("a", 0.1, 0.1), ("b", 0.3, 0.4)]
    with pytest.raises(BudgetExceeded):
        budget.spend({"c": 0.3, "d": 0.4})
    assert budget.spend({"e": 0.6}, delta=1e-5) == [("e", 0.6, 1.0)]
    # the ledger outlives the object, and what was refused is not spent
    same = Budget(spark, str(tmp_path / "ledger"), epsilon=1.0, delta=1e-5)
    assert [tuple(r)[:2] for r in same.ledger().collect()] == [("a", 0.1), ("b", 0.3), ("e", 0.6)] and same.left() < 1e-9
    with pytest.raises(BudgetExceeded):
        same.spend({"f": 1e-3})
    wider = Budget(spark, str(tmp_path / "ledger"), epsilon=2.0, delta=1e-5)
    with pytest.raises(BudgetExceeded):
        wider.spend({"g": 0.1}, delta=1e-6)
    for wrong in ({}, {"h": 0.0}):
        with pytest.raises(ValueError):
            wider.spend(wrong)


def test_nothing_is_computed_without_budget(spark, tmp_path):
    budget = Budget(spark, str(tmp_path / "ledger"), epsilon=3.0)
    df = spark.range(100).select(F.col("id").alias("v"))
    with pytest.raises(BudgetExceeded):
        dp.dp_compare(df, "v", 0, 100, 1.0, 5, budget)
    rows = dp.dp_compare(df, "v", 0, 100, 0.5, 5, budget, "small").collect()
    assert sorted(r["spent"] for r in rows) == [0.5, 1.0, 1.5, 2.0] and budget.left() == 1.0


def test_scopes_delete_what_they_wrote(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    tables = lambda: set(folder.iterdir()) if folder.exists() else set()
    before, df = tables(), spark.range(3)
    with scope(spark) as outer:
        first = materialize(df)
        with scope(spark) as inner:
            part = materialize(df)
            kept = inner.keep(part)
            assert len(tables() - before) == 3
        assert len(tables() - before) == 2 and kept.count() == first.count() == 3
        result = outer.keep(kept)
    assert len(tables() - before) == 1 and result.count() == 3
    with pytest.raises(ZeroDivisionError), scope(spark):
        materialize(df)
        raise ZeroDivisionError
    assert len(tables() - before) == 1


def coins(spark, method="marginal"):
    """Columns of a thousand, a hundred and four values; in the tree ``c`` follows ``a``."""
    df = spark.range(100_000).select(
        (F.col("id") % 1000).alias("a"), F.floor(F.col("id") / 1000).alias("b"), (F.col("id") % 4).cast("string").alias("c"), (F.col("id") * 1.5).alias("x")
    )
    return synthesize.fit(df, ["a", "b", "c"], ["x"] if method == "marginal" else [], method=method)


def test_rare_rules_need_no_rejected_draws(spark):
    """One in 10^5 a rule, one in 2 * 10^7 together: as many draws as rows."""
    rules = [constraints.RowConstraint("a = 7 AND b = 3", "rare"), constraints.RowConstraint("c = '2' OR a > 990", "other")]
    model, left = coins(spark).conditioned([*rules, constraints.RowConstraint("x > 10", "number")])
    assert [r.name for r in left] == ["number"]
    rows = synthesize.sample_valid(coins(spark), spark, 500, rules, 3, max_draws=500).collect()
    assert len(rows) == 500 and {(r["a"], r["b"], r["c"]) for r in rows} == {(7, 3, "2")}
    mixed = synthesize.sample_valid(coins(spark), spark, 200, [*rules, constraints.RowConstraint("x > 75000", "half")], 3, max_draws=2000)
    assert mixed.count() == 200 and mixed.where("x <= 75000 OR a <> 7").count() == 0
    with pytest.raises(ValueError, match="fulfils"):
        coins(spark).conditioned([constraints.RowConstraint("a = 7 AND a = 8", "never")])
    with pytest.raises(ValueError, match="columns"):
        coins(spark).conditioned([constraints.RowConstraint("nowhere = 1", "unknown")])


def test_conditioned_draws_follow_the_model(spark, tmp_path):
    """Given a rule, values are as frequent as among the unconditioned draws that fulfil it, also down a tree."""
    rule = constraints.RowConstraint("a < 2 OR (a < 6 AND c = '1')", "some")
    for method in ("marginal", "tree"):
        model, left = coins(spark, method).conditioned([rule])
        assert left == []
        model.save(str(tmp_path / method))
        out = synthesize.Model.load(spark, str(tmp_path / method)).synthesize(spark, 5, 8000).toPandas()
        share = out["a"].value_counts(normalize=True)
        if method == "marginal":  # 1, 1 and a quarter for each of 2 to 5
            want = {0: 1 / 3, 1: 1 / 3} | {a: 1 / 12 for a in (2, 3, 4, 5)}
        else:  # c is a's remainder by 4, so of 2 to 5 only 5 fulfils the rule
            want = {0: 1 / 3, 1: 1 / 3, 5: 1 / 3}
            assert (out["c"].astype(int) == out["a"] % 4).all()
        assert set(share.index) == set(want) and all(abs(share[a] - p) < 0.03 for a, p in want.items())
        assert out["b"].nunique() == 100


def test_rules_that_are_too_wide_stay_with_rejection(spark):
    rule = constraints.RowConstraint("a < b", "wide")
    same, left = coins(spark).conditioned([rule], max_cells=1000)
    assert left == [rule] and all(n.kind != "joint" for n in same.nodes)
    seen = constraints.FixedCombinations(["a", "c"], spark.createDataFrame([(1, "1"), (2, "3")], "a long, c string"))
    rows = synthesize.sample_valid(coins(spark), spark, 300, [seen], 4, max_draws=300).collect()
    assert {(r["a"], r["c"]) for r in rows} == {(1, "1"), (2, "3")} and len(rows) == 300
