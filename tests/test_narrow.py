"""What never looks at the vertical arrays does not build them; the nearest source is sought close by first."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rainloom import testbed
from rainloom.operators import colocate


@pytest.mark.parametrize("name", ["C1_rain_mask", "C6_isolated", "G2_hour_views", "T1_late_and_repeated"])
def test_no_arrays_are_built(spark, data_dir, name, monkeypatch):
    monkeypatch.setattr(testbed, "_inputs", {})
    entry_points.queries()[name](spark, data_dir)
    assert "swath" not in vars(testbed.inputs(spark, data_dir))


def test_smaller_radius_first(spark, monkeypatch):
    row = [F.lit("GPM").alias("mission"), F.lit(1).alias("orbit"), F.lit(0).alias("scan"), F.col("id").cast("int").alias("ray")]
    targets = spark.range(40).select(*row, F.lit(0.0).alias("lat"), (F.col("id") * 0.04).alias("lon"))
    # the far end of the line has its nearest source beyond the smaller radius, or none
    sources = targets.where("ray < 30").withColumn("pct", F.col("ray").cast("double"))
    steps, stored = [], colocate.materialize
    monkeypatch.setattr(colocate, "materialize", lambda df, label: steps.append(label) or stored(df, label))
    got = sorted(colocate.nearest_within(targets, sources, "pct").collect())
    assert steps == ["nearest"]
    assert got == sorted(colocate.nearest_within(targets, sources, "pct", first_m=0).collect())
    assert steps == ["nearest"] and [r.source_ray for r in got] == [min(r, 29) for r in range(33)]


def test_large_sources_are_not_dealt_again(spark):
    cores = spark.sparkContext.defaultParallelism
    assert "Exchange" not in testbed._spread(spark.range(100, numPartitions=cores))._jdf.queryExecution().executedPlan().toString()
    assert testbed._spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
