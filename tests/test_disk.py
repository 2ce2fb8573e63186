"""What queries leave on disk: shuffled rows of the nearest search, shuffle files, tables that nothing reads any more."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rainloom import testbed
from rainloom.operators import colocate
from rainloom.session import materialize, shared_folder
from rainloom.sources import lake


def shuffled_rows(df):
    """Rows that went through an exchange, from the metrics of the plan that ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_nearest_sends_few_copies(spark):
    row = [F.lit("GPM").alias("mission"), F.lit(1).alias("orbit"), F.floor(F.col("id") / 40).cast("int").alias("scan"), (F.col("id") % 40).cast("int").alias("ray")]
    grid = spark.range(1600).select(*row).withColumns({"lat": F.col("scan") * 0.04, "lon": F.col("ray") * 0.04, "pct": F.lit(250.0)})
    found = colocate.nearest_within(materialize(grid, "t"), materialize(grid, "s"), "pct", 5000.0, first_m=0)
    assert shuffled_rows(found) < 7 * 1600  # nine copies of every target before, beside the sources and what is found
    assert found.where("distance_km = 0").count() == 1600


@pytest.mark.parametrize("lat", [-89.97, 89.2, 60.0, 0.0])
def test_every_tile_in_reach_is_searched(spark, lat):
    row = [F.lit("GPM").alias("mission"), F.lit(1).alias("orbit"), F.lit(0).alias("scan"), F.col("id").cast("int").alias("ray")]
    targets = spark.range(72).select(*row, F.lit(lat).alias("lat"), (F.col("id") * 5.0 - 180.0).alias("lon"))
    # one source 14.9 km from each target, in eight directions
    away, turn = 14.9 / colocate.KM_PER_DEG, F.radians(F.col("ray") % 8 * 45.0)
    p, d = F.radians("lat"), F.radians(F.lit(away))
    north = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(turn))
    east = F.atan2(F.sin(turn) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(north))
    sources = targets.withColumn("pct", F.lit(1.0)).withColumns({"lon": F.pmod(F.col("lon") + F.degrees(east) + 180.0, F.lit(360.0)) - 180.0, "lat": F.degrees(north)})
    assert colocate.nearest_within(targets, sources, "pct", first_m=0).count() == 72


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    lake._write_months(stored.select("count", F.lit("GPM").alias("mission"), F.lit(2024).alias("year"), F.lit(1).alias("month")), str(tmp_path / "m"))
    assert shuffle_files(spark) <= before
    assert stored.count() == 7


@pytest.mark.parametrize("name", ["A4_bbox", "G18_month_job", "IO1_read_months"])
def test_arrays_are_not_stored(spark, data_dir, name, monkeypatch):
    monkeypatch.setattr(testbed, "_inputs", {})
    entry_points.queries()[name](spark, data_dir).collect()
    assert "swath" not in vars(testbed.inputs(spark, data_dir))


def test_writers_drop_their_staging(spark, data_dir):
    before = set(Path(shared_folder(spark), "rainloom").glob("write-*"))
    for name in ("IO4_write_pixels", "IO6_write_environment", "IO7_G18_month_run_twice", "IO5_write_views"):
        entry_points.queries()[name](spark, data_dir).collect()
    assert set(Path(shared_folder(spark), "rainloom").glob("write-*")) == before
