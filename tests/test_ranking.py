import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import ranking as rk
from rainloom.operators import sets
from rainloom.plans import models


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, with many ties."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 17}", float(rng.choice([0, 1, 1, 2, rng.randint(0, 500)]))) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id int, g string, x double")


def test_exact_percentiles_with_ties(skewed):
    rows, df = skewed
    got = {r.g: r for r in rk.exact_percentiles(df, ("g",), "x", {"p01": 0.01, "p50": 0.5, "p999": 0.999}).collect()}
    for g in {r[1] for r in rows}:
        x = np.array([r[2] for r in rows if r[1] == g])
        assert got[g].n == len(x)
        for name, p in (("p01", 1), ("p50", 50), ("p999", 99.9)):
            assert got[g][name] == pytest.approx(np.percentile(x, p))
    bounded = {r.g: r.p50 for r in rk.exact_percentiles(df, ("g",), "x", {"p50": 0.5}, bounded=True).collect()}
    assert bounded == {g: r.p50 for g, r in got.items()}


def test_percentile_of_single_value_and_nan(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", None), ("a", float("nan"))], "g string, x double")
    row = rk.exact_percentiles(df, ("g",), "x", {"p": 0.9}).first()
    assert (row.p, row.n) == (4.0, 1)


def test_row_numbers_are_global(skewed):
    rows, df = skewed
    got = {r.id: (r.rn, r.rn_total) for r in rk.row_numbers(df, ["x", "id"], ("g",)).collect()}
    for g in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == g)
        for k, (_, i) in enumerate(mine, 1):
            assert got[i] == (k, len(mine))


@pytest.mark.parametrize("n", [1, 3, 4, 5, 11])
def test_quartiles_equal_ntile(spark, n):
    from pyspark.sql import Window

    df = spark.range(n).withColumn("x", F.lit(1.0))
    want = {r.id: r.q for r in df.withColumn("q", F.ntile(4).over(Window.orderBy("x", "id"))).collect()}
    assert {r.id: r.quantile for r in rk.quantile_group(df, "x", 4, "id").collect()} == want


def test_top_k_skips_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 7.0), (5, 7.0)], "feature_id int, x double")
    assert [r.feature_id for r in rk.top_k(df, "x", 2).collect()] == [4, 5]
    assert [r.feature_id for r in rk.top_k(df, "x", 1, largest=False).collect()] == [1]


def test_missing_months(spark):
    inv = spark.createDataFrame([("TRMM", 2014, 10), ("TRMM", 2015, 2), ("GPM", 2014, 3)], "mission string, year int, month int")
    assert sorted((r.year, r.month) for r in sets.missing_months(inv).collect()) == [(2014, 11), (2014, 12), (2015, 1)]


def test_same_rows_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    assert sets.same_rows(a, a).isEmpty()
    assert [(r.x, r.side) for r in sets.same_rows(a, b).collect()] == [(1, "left")]


@pytest.fixture(scope="module")
def environment(spark):
    rng = np.random.default_rng(3)
    n = 1500
    cape, cin = rng.uniform(0, 3000, n), rng.uniform(-100, 0, n)
    shear = 20 - cape / 300 + rng.normal(0, 2, n)
    y = 4 + 0.002 * cape + 0.15 * shear + rng.normal(0, 0.2, n)
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(cape, cin, shear, y))]
    return rows, spark.createDataFrame(rows, "feature_id long, cape double, mean_cin_2p50deg double, shear double, y double")


def test_ols_matches_least_squares(environment):
    rows, df = environment
    got = {r.term: r.coefficient for r in models.fit_ols(df, "y", ("cape", "shear")).collect()}
    x = np.array([[r[1], r[3]] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want, *_ = np.linalg.lstsq(np.c_[z, np.ones(len(z))], np.array([r[4] for r in rows]), rcond=None)
    assert [got["cape"], got["shear"], got["const"]] == pytest.approx(list(want), rel=1e-6)


def test_partial_effect_recovers_the_slope(environment):
    _, df = environment
    row = models.partial_effect(df, "y", "shear", ["cape", "mean_cin_2p50deg"], nuisance="linear").first()
    assert row.effect == pytest.approx(0.15, abs=0.01) and row.std_error < 0.01 and row.n == 1500


def test_local_effects_rise_with_the_predictor(environment):
    _, df = environment
    model, importance = models.fit_gbt(df, "y", ("cape", "shear"), rounds=8, depth=4)
    assert importance.first().test_r2 > 0.8
    curve = models.ale(model, df, "cape", ("cape", "shear"), bins=8).orderBy("bin").collect()
    assert curve[-1].effect > 1.0 > -1.0 > curve[0].effect
    assert sum(r.n for r in curve) == 1500


def test_cin_imputed_and_rows_dropped(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, -5.0, None)], "feature_id int, mean_cin_2p50deg double, y double")
    got = models.prepare_predictors(df, "y", ("mean_cin_2p50deg",)).collect()
    assert [(r.feature_id, r.mean_cin_2p50deg) for r in got] == [(1, 0.0)]


def test_ordinals_do_not_depend_on_the_splits(spark, tmp_path):
    from rainloom.functions.ranking import input_ordinal

    path = str(tmp_path / "rows")
    spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 16384).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = input_ordinal(spark.read.parquet(path)).collect()
            assert sorted(r.ordinal for r in rows) == list(range(5000)) and all(r.ordinal == r.id for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert input_ordinal(spark.read.schema("id long, x string").parquet(path).where("id < 0")).count() == 0
