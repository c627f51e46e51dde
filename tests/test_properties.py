"""Properties: partitioning does not matter, hot keys do not gather, draws follow counts."""

import collections

import pytest
from pyspark.sql import functions as F

from twinlake.functions.rand import uniform
from twinlake.operators import anonymity, clean, draw, dp
from twinlake.operators.bayesnet import BayesNet
from twinlake.operators.generate import Conditional, DrawFrom, UniformInt, Weighted, generate, rows
from twinlake.operators.pseudonym import pseudonymize
from twinlake.operators.rank import exact_quantiles, global_cumulative, global_rank
from twinlake.plans import examples
from twinlake.plans.recipe import PRESETS as RECIPES
from twinlake.plans.validate import PRESETS, Validation, validate
from twinlake.sources import tabular
from twinlake.sources.roles import Roles
from twinlake.sources.scratch import materialize, shared_dir
from twinlake.streaming import steps


def skewed(spark, n=3000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") * 7919 % 1009).alias("v"),
    )


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_results_do_not_depend_on_partitioning(spark, parts):
    df = skewed(spark).repartition(parts)
    got = {
        "pseudonym": sorted(map(tuple, pseudonymize(df, "k", 1).collect())),
        "bounded": sorted(map(tuple, dp.bound_contributions(df, "k", 3, 1, ["id"]).collect())),
        "first": sorted(map(tuple, clean.first_per_key(df, "k", "id").collect())),
        "median": [tuple(r) for r in exact_quantiles(df, ["k"], "v", [0.5]).orderBy("k").collect()],
        "t": sorted((r[0], round(r[1], 9)) for r in anonymity.class_t(df, ["k"], "v", "ordered").collect()),
    }
    base = test_results_do_not_depend_on_partitioning.__dict__.setdefault("seen", got)
    assert got == base


def test_sparse_and_dense_distances_agree(spark, monkeypatch):
    df = skewed(spark).withColumn("q", F.col("k") % 5)
    dense = {r[0]: r[1] for r in anonymity.class_t(df, ["q"], "k", "ordered").collect()}
    monkeypatch.setattr(anonymity, "DENSE_LEVELS", 0)
    sparse = {r[0]: r[1] for r in anonymity.class_t(df, ["q"], "k", "ordered").collect()}
    assert dense.keys() == sparse.keys()
    assert all(dense[k] == pytest.approx(sparse[k], abs=1e-9) for k in dense)


def test_hot_keys_are_cut_down_before_the_shuffle(spark):
    df = skewed(spark)
    assert "WindowGroupLimit" in plan(clean.first_per_key(df, "k", "id"))
    assert "WindowGroupLimit" in plan(dp.bound_contributions(df, "k", 3, 1, ["id"]))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(clean.suppress_patterns(df.filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_returnflag"), [{"l_returnflag": "R"}]))
    assert "PushedFilters: [In(l_returnflag" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_global_rank_and_running_sum(spark):
    df = skewed(spark).select("id", F.lit(2).alias("w"))
    ranked, n = global_rank(df, F.col("id").desc())
    assert n == 3000 and {r["id"]: r["rank"] for r in ranked.collect()}[2999] == 1
    cum, rows_, total = global_cumulative(df, "id", "w")
    got = {r["id"]: r for r in cum.collect()}
    assert (rows_, total) == (3000, 6000)
    assert got[99]["cum"] == 200 and got[99]["cum_cum"] == sum(2 * (i + 1) for i in range(100))


@pytest.mark.parametrize("array_levels", [256, 0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_draws_follow_the_counts(spark, monkeypatch, array_levels, by):
    monkeypatch.setattr(draw, "ARRAY_LEVELS", array_levels)
    monkeypatch.setattr(draw, "BLOCK", 8)
    src = skewed(spark).withColumn("g", F.col("id") % 2)
    cells = materialize(draw.value_counts(src, by, "v"))
    base = spark.range(2000).withColumn("g", F.col("id") % 2)
    u = uniform(5, "v", "id")
    got = {r["id"]: r["v"] for r in draw.draw_weighted(base, cells, by, "v", u, "v").collect()}
    pools = collections.defaultdict(list)
    for r in sorted(cells.collect(), key=lambda r: r["v"]):
        pools[r["g"] if by else None] += [r["v"]] * r["__n"]
    for r in base.withColumn("u", u).collect():
        pool = pools[r["g"] if by else None]
        assert got[r["id"]] == pool[int(r["u"] * len(pool))]


def test_network_tables_sum_to_one_and_unseen_states_are_uniform(spark):
    # g=1, a=1 never occurs together
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 1), (0, 0, 0)], "g int, a int, n int")
    net = BayesNet([("g", "n"), ("a", "n")]).fit(df)
    assert net.check().count() == 0
    made = net.simulate(spark.range(4000), 3)
    assert made.filter("n is null").count() == 0
    unseen = made.filter("g = 1 and a = 1").agg(F.avg("n")).first()[0]
    assert 0.4 < unseen < 0.6
    with pytest.raises(ValueError):
        BayesNet([("a", "b"), ("b", "a")])


def test_generated_shares(spark):
    spec = {
        "g": Weighted({"m": 1, "w": 3}),
        "band": Conditional("g", {"m": {"x": 1}, "w": {"y": 1}}),
        "n": UniformInt(3, 5),
    }
    df = generate(rows(spark, 8000), spec, 1)
    assert abs(df.filter("g = 'w'").count() / 8000 - 0.75) < 0.03
    assert df.filter("(g = 'm') <> (band = 'x')").count() == 0
    assert {r[0] for r in df.select("n").distinct().collect()} == {3, 4, 5}


def test_draw_from_unknown_parent_is_null(spark):
    dim = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, c string")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")
    df = generate(base, {"c": DrawFrom(dim, {"p": "p"}, {"c": "c"})}, 1)
    got = {r["id"]: r["c"] for r in df.collect()}
    assert got[1] in ("x", "y") and got[2] is None


def register(spark, n, seed):
    codes = spark.createDataFrame(
        [(1010, "Wien"), (2020, "Hollabrunn,Suttenbrunn"), (4020, "Linz"), (5020, "Salzburg"), (6020, "Innsbruck"),
         (6800, "Feldkirch"), (7000, "Eisenstadt"), (8010, "Graz"), (9020, "Klagenfurt")],
        "code int, cities string",
    )
    return generate(rows(spark, n), examples.vaccination_register(codes), seed)


def test_register_is_consistent_and_recipe_applies(spark):
    df = materialize(register(spark, 1500, 1))
    assert df.filter("Postleitzahl is null or Ort is null").count() == 0
    off = F.col("`FSME Impfung`") == 0
    assert df.filter(off & F.col("`FSME Impfstoff`").isNotNull()).count() == 0
    assert df.filter(F.col("`FSME Impfdatum`") > "2022-04-30").count() == 0
    assert df.filter(F.col("`Covid Impfdatum`") >= F.col("`Covid Ablaufdatum des Impfstoffs`")).count() == 0
    copied = (F.col("`Polio Impfung`") == 1) & ~F.col("`Polio Impfstoff`").eqNullSafe(F.col("`Tetanus und Diphterie Impfstoff`"))
    assert df.filter(copied).count() == 0
    texts = df.drop("id", "Alter", "Alterskategorie").withColumn("Geburtsdatum", F.col("Geburtsdatum").cast("string"))
    recipe = RECIPES["register"]
    safe = materialize(recipe.apply(texts, 1))
    got = {(r["measure"], r["attribute"]): r["value"] for r in recipe.measure(safe).collect()}
    assert got[("k", None)] > 15 and got[("l", None)] >= 1
    assert all(0 <= v <= 1 for (m, _), v in got.items() if m == "t")


def test_validation_phases_of_the_register(spark, tmp_path):
    o, s = (materialize(register(spark, 400, i).drop("Alter", "Alterskategorie")) for i in (1, 2))
    got = validate(
        o, s, PRESETS["register"], "register", "rules", ["id"], ("structure", "bivariate", "privacy"), str(tmp_path)
    )
    assert set(got) == {"structure", "bivariate", "privacy"}
    assert got["structure"].filter("metric = 'missing_similarity'").count() == 25
    assert got["bivariate"].select("crosstab").distinct().count() == 8
    assert got["privacy"].count() == 9
    assert spark.read.parquet(f"{tmp_path}/privacy").select("section").distinct().count() == 1


def test_validation_with_settings_of_the_other_side(spark):
    o = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("f"))
    o = o.withColumn("t", F.when(F.col("f") == "a", "yes").otherwise("no"))
    s = o.select("id", F.upper("f").alias("g"), F.upper("t").alias("t"))
    roles = Roles(categorical=["f", "g", "t"])
    spec = Validation(roles=roles, features=["f"], features_other=["g"], targets=["t"], models=("tree",))
    got = validate(o, s, spec, "d", "m", ["id"], ("applicability",), share_codes=False)["applicability"]
    assert {(r["side"], r["value"]) for r in got.collect()} == {("original", 1.0), ("other", 1.0)}

    def bought(rare):
        items = F.when(F.col("id") < rare, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("d")))
        return spark.range(10).select("id", F.explode(items).alias("item"), F.lit(1).alias("n"))

    for other, kept in ((None, 0.0), (0.1, 1.0)):
        spec = Validation(roles=Roles(), basket=("id", "item", "n"), min_support=0.5, min_support_other=other)
        rules = validate(bought(10), bought(2), spec, "d", "m", ["id"], ("applicability",))["applicability"]
        assert rules.first()["value"] == kept


def test_files_with_other_encodings_and_bom(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("a;b\nStraße;1,5\nx;2,25\n".encode("iso-8859-1"))
    (tmp_path / "bom.csv").write_bytes("﻿a;b\nStraße;1,5\n".encode())
    latin = tabular.read_csv(spark, str(tmp_path / "latin.csv"))
    assert [tuple(r) for r in latin.collect()] == [("Straße", 1.5), ("x", 2.25)]
    bom = tabular.read_csv(spark, str(tmp_path / "bom.csv"))
    assert bom.columns == ["a", "b"] and bom.first()["a"] == "Straße"
    assert set(tabular.read_folder(spark, str(tmp_path))) == {"latin", "bom"}
    picked = tabular.read_csv(spark, str(tmp_path / "latin.csv"), columns=[1], names=["n"])
    assert picked.columns == ["n"]


def test_missing_files_are_errors(spark, tmp_path):
    for name in ("o", "s"):
        (tmp_path / name).mkdir()
    (tmp_path / "o" / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "s" / "m_b.csv").write_text("x;y\n1;2\n")
    with pytest.raises(FileNotFoundError):
        tabular.pair_datasets(spark, str(tmp_path / "o"), str(tmp_path / "s"))
    (tmp_path / "one.csv").write_text("x\n1\n2\n")
    with pytest.raises(ValueError):
        tabular.detect_delimiter(spark, str(tmp_path / "one.csv"))


def test_whole_table_steps_are_rejected_on_streams(spark, sf_dir):
    stream = steps.stream_files(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, "events.parquet")
    with pytest.raises(ValueError):
        steps.apply_steps(stream, [{"op": "pseudonymize", "col": "user_id"}], 1)


def test_scratch_folder_comes_from_the_session(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
