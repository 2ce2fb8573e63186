"""Jobs from a lake root to a lake root; each reads its input once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.operators.environment import env_for_features
from rainloom.operators.features import build_features, build_pixels, join_members
from rainloom.operators.gridding import grid_months, orbit_views
from rainloom.operators.labels import label_features
from rainloom.plans.climatology import annual_fields
from rainloom.session import materialize
from rainloom.sources import lake


def run_swath(swath: DataFrame, side: DataFrame, root: str) -> DataFrame:
    """Features, pixels and views of whole orbits; returns the orbits skipped for want of any time."""
    labels = materialize(label_features(swath, areas=side), "job-labels")
    members = materialize(join_members(swath, labels, side), "job-members")
    features = materialize(build_features(swath, labels, members), "job-features")
    lake.write_features(features, root)
    lake.write_pixels(build_pixels(swath, labels, members), features, root)
    return lake.write_views(orbit_views(swath), root)


def run_env(spark: SparkSession, root: str, reanalysis: DataFrame, start, end) -> DataFrame:
    """Environment of the stored features of the orbits that start in [start, end), written per orbit."""
    features = lake.features_for_orbits_starting(lake.read_table(spark, root, "features"), start, end)
    features = materialize(features.select("feature_id", "mission", "orbit", "time", "centroid_lat", "centroid_lon"), "job-features")
    lake.write_env(env_for_features(features, reanalysis), root, features)
    return features.groupBy("mission", "orbit").agg(F.count("*").alias("n_features"))


def run_grids(swath: DataFrame, labels: DataFrame, features: DataFrame, root: str, **options) -> DataFrame:
    """Month grids of a swath; returns every (mission, year, month) that was processed with its rows.

    A month without rain has no directory in the rain table; the report tells it from one never run. A month
    that is run again is replaced in every table and in the report, also where it has no rows any more.
    """
    months = swath.where(F.col("time").isNotNull()).select(F.upper("mission").alias("mission"), F.year("time").alias("year"), F.month("time").alias("month")).distinct()
    months = materialize(months, "job-run")
    report = months
    for name, grid in grid_months(swath, labels, features, **options).items():
        if f"grid_{name}" not in lake.TABLES:
            continue
        lake.write_grid(grid, root, name, months)
        stored = lake.read_table(swath.sparkSession, root, f"grid_{name}", granule=False).join(F.broadcast(months), lake.MONTH, "left_semi")
        counts = stored.groupBy("mission", "year", "month").agg(F.count("*").alias(f"n_{name}"))
        report = report.join(counts, ["mission", "year", "month"], "left")
    report = materialize(report.fillna(0), "job-months")
    lake.write_report(report, root)
    return report


def run_climatology(spark: SparkSession, root: str, out: str, months=None, **options) -> DataFrame:
    """Annual fields from the stored month grids, written to ``out`` and returned."""
    rain, views, metrics = (lake.read_table(spark, root, f"grid_{n}", months=months, granule=False).drop("year") for n in ("rain", "views", "metrics"))
    annual_fields(rain, views, metrics, **options).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
