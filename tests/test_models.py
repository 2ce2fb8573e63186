"""Fits pass over stored rows, so what derives them runs once; wide projections stay within what the JVM compiles."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rainloom import testbed
from rainloom.plans import boosting, models
from rainloom.session import HUGE_METHODS, growing


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined(spark):
    k = F.col("id")
    left = spark.range(200).select(k.alias("feature_id"), (k % 7 + k % 3 + k % 5 / 10).alias("y"))
    return left.join(growing(spark.range(200).select(k.alias("feature_id"), (k % 7).cast("double").alias("x"), (k % 3).cast("double").alias("t"))), "feature_id")


def test_partial_effect_joins_once(joined):
    assert "Join" in _plan(joined) and "Join" not in _plan(models.partial_effect(joined, "y", "t", ["x"], nuisance="linear"))


@pytest.mark.parametrize("fit", [lambda df: models.fit_gbt(df, "y", ("x", "t"), rounds=2, depth=2), lambda df: models.fit_extreme_classifier(df.withColumn("e", (F.col("y") > 6).cast("int")), "e", ("x", "t"), rounds=2, depth=2)])
def test_boosted_fits_join_once(joined, monkeypatch, fit):
    seen, split = [], models.hash_split
    monkeypatch.setattr(models, "hash_split", lambda df, *x: seen.append(_plan(df)) or split(df, *x))
    fit(joined)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_exact_fit_leaves_no_tables(joined, monkeypatch):
    paths, write = [], boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, label: paths.append(write(df, label)) or paths[-1])
    boosting.fit_exact(joined.withColumn("train", F.lit(True)), "y", ("x", "t"), rounds=2, depth=1)
    assert len(paths) == 2 and not any(os.path.exists(p.stored_at) for p in paths)


def test_extremes_join_once(spark, data_dir, monkeypatch):
    monkeypatch.setattr(testbed, "_inputs", {})
    seen, split = [], boosting.md5_split
    monkeypatch.setattr(boosting, "md5_split", lambda df, *x: seen.append(_plan(df)) or split(df, *x))
    entry_points.queries()["H17_exact_precision"](spark, data_dir)
    assert len(seen) == 1 and "SortMergeJoin" not in seen[0]


def test_methods_can_be_compiled(spark):
    spark.conf.set(HUGE_METHODS, "65535")
    testbed.inputs(spark, "nowhere")
    assert spark.conf.get(HUGE_METHODS) == "8000"
