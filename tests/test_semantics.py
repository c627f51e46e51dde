"""Hand-worked small tables for each definition."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from twinlake.functions import dates
from twinlake.functions import generalize as g
from twinlake.functions.rand import normalise
from twinlake.operators import anonymity, association, basket, clean, constraints, dp, fidelity, joins, leakage, utility
from twinlake.operators.pseudonym import id_from_pattern, pseudonymize
from twinlake.operators.rank import exact_quantiles
from twinlake.operators.synthesize import fit, sample_valid
from twinlake.plans.recipe import PRESETS, Recipe
from twinlake.sources.roles import Roles


def one(df):
    return df.collect()[0]


def col(df, name):
    return [r[name] for r in df.collect()]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(-1,), (0,), (14,), (15,), (101,), (102,), (None,)], "a int")
    got = col(df.select(g.bin_numeric("a", g.AGE_EDGES, g.AGE_LABELS).alias("b")), "b")
    assert got == [None, "<15", "<15", "15-29", ">74", None, None]
    left = col(df.select(g.bin_numeric("a", [0, 15, 101], ["x", "y"], right=False).alias("b")), "b")
    assert left == [None, "x", "x", "y", None, None, None]


def test_bins_reject_bad_edges():
    with pytest.raises(ValueError):
        g.bin_numeric(F.lit(1), [1, 1, 2])


def test_prefix_rules(spark):
    df = spark.createDataFrame([("1010",), ("6020",), ("9990",), ("0123",), ("12",), (None,)], "c string")
    assert col(df.select(g.generalize_prefix("c").alias("p")), "p") == ["1", "60", "99", "0123", "12", None]


def test_assemble_date_guards(spark):
    rows = [(31, 2, 2020), (29, 2, 2020), (29, 2, 2021), (0, 1, 2020), (1, 13, 2020), (1, 1, 999), (None, 1, 2020)]
    df = spark.createDataFrame(rows, "d_day int, d_month int, d_year int")
    assert col(dates.assemble_date(df, "d"), "d") == [None, "29.02.2020", None, None, None, None, None]


def test_assemble_with_time(spark):
    df = spark.createDataFrame([(1, 2, 2020, 13, 5)], "d_day int, d_month int, d_year int, d_hour int, d_minute int")
    assert col(dates.assemble_date(df, "d", True, True), "d") == ["01.02.2020 13:05"]


def test_recode_null_and_keep(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("?",), (None,)], "a string")
    assert col(clean.recode(df, "a", {"Yes": True, "No": False}), "a") == [True, False, None, None]
    assert col(clean.recode(df, "a", {"Yes": "True"}, "keep"), "a") == ["True", "No", "?", None]
    long = {str(i): f"v{i}" for i in range(300)} | {"Yes": "y"}
    assert sorted(map(str, col(clean.recode(df, "a", long, "keep"), "a"))) == ["?", "No", "None", "y"]


def test_patterns_ignore_null(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), ("x", 2)], "a string, b int")
    assert len(clean.suppress_patterns(df, [{"a": "x", "b": 1}]).collect()) == 2


def test_small_groups_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] * 2 + [(None, 1)] * 5, "q string, v int")
    assert col(anonymity.suppress_small_groups(df, ["q"], 2), "q") == ["a"] * 3


def test_min_distinct_keeps_groups_without_first_rows(spark):
    # member 1 counts only in group a, so group b has no first row of its own
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (1, "b", 3), (3, "c", 4)], "m int, grp string, o int")
    kept = anonymity.suppress_min_distinct(df, "grp", "m", "o", 2)
    assert sorted(col(kept, "grp")) == ["a", "a", "b"]
    strict = anonymity.suppress_min_distinct(df, "grp", "m", "o", 2, drop_zero=True)
    assert sorted(col(strict, "grp")) == ["a", "a"]


def test_k_and_l(spark):
    rows = [("x", "f"), ("x", "f"), ("y", "f"), ("y", None), ("y", "c")]
    df = spark.createDataFrame(rows, "q string, s string")
    assert one(anonymity.k_anonymity(df, ["q"]))["k"] == 2
    got = {r["q"]: r["l_s"] for r in anonymity.class_distinct(df, ["q"], ["s"]).collect()}
    assert got == {"x": 1, "y": 3}
    assert one(anonymity.l_diversity(df, ["q"], ["s"]))["l"] == 1


def test_t_categorical_by_hand(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("y", "b")], "q string, s string")
    got = {r["q"]: r["t"] for r in anonymity.class_t(df, ["q"], "s").collect()}
    assert got["x"] == pytest.approx(0.25) and got["y"] == pytest.approx(0.25)


@pytest.mark.parametrize("dense", [1000, 0])
def test_t_ordered_published_example(spark, monkeypatch, dense):
    # salary example of the t-closeness paper: classes {3,4,5}, {6,8,11}, {7,9,10} thousand
    monkeypatch.setattr(anonymity, "DENSE_LEVELS", dense)
    rows = [("p", v) for v in (3, 4, 5)] + [("q", v) for v in (6, 8, 11)] + [("r", v) for v in (7, 9, 10)]
    df = spark.createDataFrame(rows, "q string, s int")
    got = {r["q"]: r["t"] for r in anonymity.class_t(df, ["q"], "s", "ordered").collect()}
    assert got["p"] == pytest.approx(0.375)
    assert got["q"] == pytest.approx(0.167, abs=1e-3)


def test_pseudonyms_are_injective_and_null_counts(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(400)] + [(None,)], "k long")
    out = pseudonymize(df.withColumn("raw", F.col("k")), "k", "s")
    pairs = {(r["raw"], r["k"]) for r in out.collect()}
    assert len(pairs) == 51 == len({p for _, p in pairs})
    assert all(1 <= p <= 5 * 51 - 1 for _, p in pairs)
    hashed = pseudonymize(df.withColumn("raw", F.col("k")), "k", "s", method="hash", null_as_value=False)
    assert {r["k"] for r in hashed.filter("raw is null").collect()} == {None}


def test_id_pattern(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "i long")
    assert col(df.select(id_from_pattern("C[0-9]{6}", "i").alias("x")), "x") == ["C000007", None]
    with pytest.raises(ValueError):
        id_from_pattern("[A-Z]+", F.lit(1))


def test_exact_quantiles_match_linear_interpolation(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, 3, 3, 3)] + [("b", 2.0)], "c string, v double")
    got = {(r["c"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["c"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got[("a", 0.0)] == 1 and got[("a", 0.25)] == 2 and got[("a", 0.5)] == 3 and got[("a", 1.0)] == 9
    assert got[("b", 0.5)] == 2


def test_metrics_of_a_table_with_itself_are_one(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, None)], "n double, c string")
    out = (
        fidelity.statistic_similarity(df, df, ["n"])
        .unionByName(fidelity.range_coverage(df, df, ["n"]))
        .unionByName(fidelity.boundary_adherence(df, df, ["n"]))
        .unionByName(fidelity.category_coverage(df, df, ["c"]))
        .unionByName(fidelity.tv_complement(df, df, ["n", "c"]))
        .unionByName(fidelity.missing_similarity(df, df, ["n", "c"]))
    )
    assert all(v == pytest.approx(1) for v in col(out, "value"))


def test_zero_range_is_null(spark):
    o = spark.createDataFrame([(1.0,), (1.0,)], "n double")
    assert col(fidelity.range_coverage(o, o, ["n"]), "value") == [None]


def test_empty_synthetic(spark):
    o = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "n double, c string")
    s = o.filter("n > 5")
    assert col(fidelity.category_coverage(o, s, ["c"]), "value") == [0.0]
    assert col(fidelity.range_coverage(o, s, ["n"]), "value") == [None]
    assert col(fidelity.tv_complement(o, s, ["c"]), "value") == [None]
    assert one(leakage.leak_report(o, s, [["c"]]))["matched"] == 0
    roles = Roles(continuous=["n"], categorical=["c"])
    report = {(r["metric"], r["column"]): r["value"] for r in fidelity.structural_report(o, s, roles, "d", "m").collect()}
    assert report[("category_coverage", "c")] == 0 and report[("mean_similarity", "n")] is None


def test_tuples_do_not_run_together(spark):
    o = spark.createDataFrame([("a", "bc"), (None, "x")], "p string, q string")
    s = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "x")], "p string, q string")
    flagged = leakage.pii_leak(o, s, ["p", "q"]).collect()
    assert [r["p+q_in_original"] for r in sorted(flagged, key=lambda r: str(r["p"]))] == [True, True, False]
    assert one(leakage.leak_report(o, s, [["p", "q"]]))["matched"] == 2


def test_marker_join_does_not_repeat_rows(spark):
    o = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    s = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted((r["k"], r["hit"]) for r in joins.mark_exists(s, o, ["k"], "hit").collect()) == [(1, True), (3, False)]


def test_perfect_and_no_association(spark):
    rows = [(a, a.upper(), b) for a in "ab" for b in "xy" for _ in range(50)]
    df = spark.createDataFrame(rows, "a string, u string, b string")
    assert one(association.cramers_v(df, "a", "u"))["value"] == pytest.approx(1, abs=0.01)
    assert one(association.cramers_v(df, "a", "b"))["value"] == pytest.approx(0, abs=1e-9)
    u = {(r["x"], r["y"]): r["value"] for r in association.theils_u(df, "a", "u").collect()}
    assert u[("a", "u")] == pytest.approx(1) and u[("u", "a")] == pytest.approx(1)


def test_correlation_ratio_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)], "c string, n double")
    assert one(association.correlation_ratio(df, ["c"], ["n"]))["value"] == pytest.approx(math.sqrt(16 / 20))


def test_rules_by_hand(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "a")]
    df = spark.createDataFrame(rows, "k int, i string").withColumn("q", F.lit(1))
    pairs = basket.baskets(df, "k", "i", "q")
    assert pairs.select("k").distinct().count() == 3  # the single-item basket is out
    itemsets, n = basket.frequent_itemsets(pairs, "k", "i", 0.5)
    assert n == 3
    assert {tuple(r["items"]): r["freq"] for r in itemsets.collect()} == {("a",): 3, ("b",): 2, ("a", "b"): 2}
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in basket.association_rules(itemsets).collect()}
    assert set(rules) == {(("a",), ("b",)), (("b",), ("a",))}
    assert rules[(("b",), ("a",))]["confidence"] == 1 and rules[(("b",), ("a",))]["conviction"] == math.inf
    kept = one(basket.rule_retention(basket.association_rules(itemsets), basket.association_rules(itemsets)))
    assert kept["retention"] == 1
    none = basket.association_rules(itemsets, "lift", 99)
    assert one(basket.rule_retention(none, none))["retention"] == 0


def test_quantity_rules(spark):
    df = spark.createDataFrame([(1, "a", -1), (1, "b", 0), (1, "c", None), (1, "d", 2), (1, "e", 1)], "k int, i string, q int")
    assert sorted(col(basket.baskets(df, "k", "i", "q"), "i")) == ["d", "e"]


def test_weights_are_normalised():
    assert normalise([1, 1, 2]) == [0.25, 0.5, 1.0]
    with pytest.raises(ValueError):
        normalise([0, 0])


def test_constraints(spark):
    rows = [("Died", None, "d"), ("Died", "r", "d"), ("Recovered", "r", None), (None, "r", "d"), (None, None, None)]
    df = spark.createDataFrame(rows, "status string, rec string, death string")
    rule = constraints.outcome_constraint("status", "Died", "death", "rec")
    assert len(constraints.keep_valid(df, [rule]).collect()) == 3
    rep = one(constraints.validate_constraints(df, [rule]))
    assert (rep["rows"], rep["violations"]) == (5, 2)


def test_single_class_scores_are_null(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], "label double, prediction double")
    got = one(utility.classification_scores(pred))
    assert got["accuracy"] is None and got["f1"] is None


def test_models_beat_the_majority_on_a_separable_table(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).alias("f"), F.when(F.col("id") % 4 > 1, 2).otherwise(1).alias("t"))
    for model in utility.MODELS:
        assert one(utility.evaluate(model, df, ["f"], "t", "id"))["accuracy"] > 0.95


def test_unseen_categories_leave(spark):
    o = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, c string, t string")
    s = spark.createDataFrame([(1, "a", "x"), (2, "zz", "y")], "id int, c string, t string")
    codes = utility.ordinal_codes(o, ["c", "t"], ["id"])
    assert utility.prepare_features(s, ["c"], "t", ["c", "t"], ["id"], codes=codes).count() == 1


def test_dp_noise_is_centred_and_scaled(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("v"))
    noise = [one(dp.dp_count(df, 0.1, s))["dp_count"] - 1000 for s in range(60)]
    assert abs(sum(noise) / len(noise)) < 6 and 4 < sum(map(abs, noise)) / len(noise) < 18
    assert 0 <= one(dp.dp_mean(df, "v", 0, 100, 0.001, 3))["dp_mean"] <= 100
    assert one(dp.dp_min(df, "v", 0, 100, 50.0, 1))["dp_min"] == 0
    assert one(dp.dp_max(df, "v", 0, 100, 50.0, 1))["dp_max"] == 99


def test_sampled_tuples_were_observed_and_valid(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") % 7 * 10).alias("b"), (F.col("id") * 1.0).alias("n"))
    model = fit(df, [], ["n"], fixed=[["a", "b"]], method="tree", bins=5)
    made = model.synthesize(spark, 3, 300)
    assert made.count() == 300 and made.filter("b <> a * 10 or b is null").count() == 0
    few = sample_valid(model, spark, 100, [constraints.RowConstraint("a = 3")], 3)
    assert few.count() == 100 and few.filter("a <> 3").count() == 0
    with pytest.raises(ValueError):
        sample_valid(model, spark, 10, [constraints.RowConstraint("a = 99")], 3, max_draws=20_000)


def cases(spark):
    rows = [
        ("C1", 30, "Male", f"{d:02d}.05.2020", "Recovered", "R", "p", "m", "h", "Yes", "No", None, None, None, None)
        for d in range(1, 21)
    ] + [("C2", 20, "Male", "01.06.2020", "Died", "R", "p", "m", "h", "No", "No", None, None, None, None)]
    schema = (
        "case_id string, age int, sex string, date_announced string, status string, region string, province string, "
        "muni_city string, health_status string, home_quarantined string, pregnant string, date_recovered string, "
        "date_of_death string, date_announced_as_removed string, date_of_onset_of_symptoms string"
    )
    return spark.createDataFrame(rows, schema)


def test_case_preset(spark):
    out = PRESETS["cases"].apply(cases(spark), 1)
    assert out.columns == ["case_id", "age_category", "sex", "date_announced", "status", "region"]
    assert out.count() == 20 and set(col(out, "date_announced")) == {"May 2020"}
    got = {r["measure"]: r["value"] for r in PRESETS["cases"].measure(out).collect()}
    assert got == {"k": 20, "l": 1, "t": 0}


def test_retail_preset(spark):
    rows = [(f"{i}", f"s{i}", i % 12, "A", "05.12.2010 08:26") for i in range(24)] + [("x", "s", 1, "B", "05.12.2010 08:26")] * 20
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, CustomerID long, Country string, InvoiceDate string")
    out = PRESETS["retail"].apply(df, 5)
    # every customer of B has a first row in A, so B has no first rows and stays
    assert out.filter("Country = 'A'").count() == 24 and set(col(out, "InvoiceDate")) == {"December 2010"}


def test_unknown_step():
    with pytest.raises(ValueError):
        Recipe([{"op": "explode"}], []).apply(None, 1)


def test_date_between_clamps_leap_day(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 29),)], "d date")
    assert col(df.select(F.add_months("d", 36).alias("x")), "x") == [datetime.date(2027, 2, 28)]
