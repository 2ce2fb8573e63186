"""Joins of tables that both grow are shuffled, however small their Parquet files are."""

import pytest
from pyspark.sql import functions as F

from checks import load_registry
from rainloom.operators import colocate, echotops, environment, features, gridding, labels
from rainloom.session import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lattice(spark):
    def make(*extra):
        keys = [F.lit("GPM").alias("mission"), F.lit(1).alias("orbit"), (F.col("id") / 49).cast("int").alias("scan"), (F.col("id") % 49).cast("int").alias("ray")]
        return materialize(spark.range(490).select(*keys, *extra), "lattice")

    return make


def test_nearest_is_shuffled(lattice):
    place = [(F.col("id") / 1000).alias("lat"), (F.col("id") % 49 / 10).alias("lon"), F.lit(250.0).alias("pct")]
    a, b = lattice(*place), lattice(*place)
    assert "Broadcast" not in _plan(colocate.nearest_within(a, b, "pct"))


def test_imager_is_not_broadcast(lattice):
    place = [F.lit("37").alias("channel")] + [(F.col("id") / 1000).alias(c) for c in ("lat", "lon", "sc_lat", "sc_lon")] + [F.lit(250.0).alias("pct")]
    sent = _plan(colocate.parallax_shift(lattice(*place))).split("BroadcastExchange")[1:]
    assert sent and all("Aggregate" in x.split("FileScan")[0] for x in sent)  # rows per orbit, no pixels


def test_labels_are_shuffled(lattice):
    wet = lattice(F.lit(30.0).alias("near_sfc_dbz"), F.lit(5000.0).alias("storm_top"), F.lit(20.0).alias("pixel_area"))
    lab = labels.label_features(wet)
    assert "Broadcast" not in _plan(lab)
    stored = materialize(lab, "lab")
    assert "Broadcast" not in _plan(labels.touches_edge(stored, wet))
    assert "Broadcast" not in _plan(features.join_members(wet, stored, lattice(F.lit(20.0).alias("pixel_area")), echo=False))
    assert "Broadcast" not in _plan(echotops.isolated(wet, wet))


def test_classes_and_environment_are_shuffled(lattice):
    feats = lattice(F.col("id").alias("feature_id"), F.lit(1).alias("local_label"), F.lit(9.0).alias("major_axis_km"), F.lit(5000.0).alias("max_ht_20dbz"))
    assert "Broadcast" not in _plan(gridding.class_maps(feats, feats))
    assert "Broadcast" not in _plan(gridding.join_pixels_features(feats, feats))
    assert "Broadcast" not in _plan(environment.left_env(feats, feats.withColumn("time", F.lit(0))))


def test_registered_joins_are_shuffled(spark, data_dir):
    for name in ("A10_thin", "E1_shear"):
        assert "Broadcast" not in _plan(load_registry()[name].run(spark, data_dir)), name
