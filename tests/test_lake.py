"""Writers and joins that must not lose rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainloom.operators import labels
from rainloom.plans import grid_views as gv
from rainloom.sources import lake

T0 = dt.datetime(2020, 5, 31, 12)


def features(spark, *rows):
    df = spark.createDataFrame([(m, o, k, t) for m, o, k, t in rows], "mission string, orbit int, local_label int, time timestamp")
    return df.withColumn("feature_id", F.col("orbit").cast("long") * 1000 + F.col("local_label"))


def test_joint_leaves_other_months(spark, tmp_path):
    df = spark.createDataFrame([("GPM", m, 1, 2, 3, 0, 0, 0, 1.5, 2) for m in (1, 2)], "mission string, month int, lat_bin int, lon_bin int, hour int, size_class int, echotop_class int, raintype int, rain_sum double, raining_count long")
    path = str(tmp_path / "joint")
    for m in (1, 2, 2):
        lake.write_joint(df.where(F.col("month") == m), path)
    assert sorted(r.month for r in spark.read.parquet(path).collect()) == [1, 2]


def test_orbit_without_time_fails(spark, tmp_path):
    good, bad = ("gpm", 1, 1, T0), ("GPM", 2, 1, None)
    with pytest.raises(Exception, match="no time is known for orbit GPM 2"):
        lake.write_features(features(spark, good, bad), str(tmp_path / "x"))
    with pytest.raises(Exception, match="no time is known for orbit GPM 2"):
        lake.write_pixels(features(spark, good, bad).drop("time"), features(spark, good), str(tmp_path / "y"))


def test_views_without_time_are_reported(spark, tmp_path):
    rows = [("gpm", 1, 5, 6, 7, T0), ("GPM", 2, 5, 6, 7, None)]
    views = spark.createDataFrame(rows, "mission string, orbit int, lat_bin int, lon_bin int, n_views int, time timestamp")
    skipped = lake.write_views(views, str(tmp_path))
    assert [(r.mission, r.orbit) for r in skipped.collect()] == [("GPM", 2)]
    assert lake.read_table(spark, str(tmp_path), "views", "GPM").count() == 1


def test_missions_in_any_case(spark, tmp_path):
    f = features(spark, ("gpm", 1, 1, T0), ("GPM", 3, 1, T0))
    lake.write_features(f, str(tmp_path))
    lake.write_pixels(f.drop("time"), f.withColumn("mission", F.upper("mission")), str(tmp_path))
    for table in ("features", "pixels"):
        assert sorted(r.orbit for r in lake.read_table(spark, str(tmp_path), table, "GPM").collect()) == [1, 3]


def test_orbit_that_moves_over_a_month(spark, tmp_path):
    root = str(tmp_path)
    lake.write_features(features(spark, ("GPM", 1, 1, T0), ("GPM", 2, 1, T0), ("TRMM", 1, 1, T0)), root)
    lake.write_features(features(spark, ("GPM", 1, 1, T0 + dt.timedelta(days=1))), root)
    got = sorted((r.mission, r.orbit, r.month) for r in lake.read_table(spark, root, "features").collect())
    assert got == [("GPM", 1, 6), ("GPM", 2, 5), ("TRMM", 1, 5)]


def test_component_with_an_unknown_area_goes_whole(spark, make_swath):
    pixels = {(2, 3): {"near_sfc_dbz": 30.0}, (2, 4): {"near_sfc_dbz": 30.0}, (6, 9): {"near_sfc_dbz": 30.0}, (6, 10): {"near_sfc_dbz": 30.0}}
    swath = make_swath(8, 12, pixels)
    areas = swath.where("NOT (scan = 2 AND ray = 4)")
    got = labels.label_features(swath, areas=areas).select("scan", "ray").collect()
    assert sorted(map(tuple, got)) == [(6, 9), (6, 10)]


def test_run_keys_never_collide(spark, make_swath):
    swath = make_swath(4, 6, {(1, 1): {"near_sfc_dbz": 30.0}})
    with pytest.raises(Exception, match="no run key for"):
        labels.scan_runs(labels.rain_mask(swath.withColumn("mission", F.lit("ERS")))).collect()
    with pytest.raises(Exception, match="no run key for"):
        labels.scan_runs(labels.rain_mask(swath.withColumn("ray", F.col("ray") + 4096))).collect()


def test_viewed_but_dry_is_zero(spark):
    views = spark.createDataFrame([(m, h, la, 3, 10) for m in (1, 2) for h in (0, 1) for la in (17, 18)], "month int, hour int, lat_bin int, lon_bin int, n_views long")
    rain = spark.createDataFrame([(1, 0, 17, 3, 0, 8.0, 4), (1, 0, 17, 3, 1, 2.0, 1)], "month int, hour int, lat_bin int, lon_bin int, class int, rain_sum double, raining_count long")
    season = {(r.month, r["class"]): r.rate for r in gv.seasonal_cycle(rain, views, deg=5.0).collect()}
    assert set(season) == {(m, c) for m in (1, 2) for c in range(5)} and season[2, 0] == 0 and season[1, 0] > 0
    hours = [r.rate for r in gv.diurnal_cycle_lst(rain, views, deg=5.0).collect()]
    assert len(hours) == 10 and sum(x == 0 for x in hours) == 8
    zonal = {(r.lat_bin, r["class"]): r.rate for r in gv.zonal_mean(rain, views, breakdown="raintype").collect()}
    assert zonal == {(17, 0): 0.2, (17, 1): 0.05, (17, 2): 0.0, (18, 0): 0.0, (18, 1): 0.0, (18, 2): 0.0}
    cells = {(r.lat_bin, r["class"]): (r.rate, r.freq, r.intensity) for r in gv.class_rates(rain, views).collect()}
    assert cells[17, 0] == (0.2, 0.1, 2.0) and cells[18, 1] == (0.0, 0.0, None)
    dry = gv.zonal_mean(rain.limit(0), views).collect()
    assert len(dry) == 10 and {r.rate for r in dry} == {0.0}


# --- index, windows, fingerprints ---------------------------------------------


def index_of(spark, root):
    return sorted((r.mission, int(r.granule), r.month, r.n_rows) for r in lake.orbit_index(spark, root, "features").collect())


def test_index_follows_the_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "BLOCK", 2)
    root = str(tmp_path)
    lake.write_features(features(spark, ("GPM", 1, 1, T0), ("GPM", 1, 2, T0), ("GPM", 5, 1, T0), ("TRMM", 1, 1, T0)), root)
    assert index_of(spark, root) == [("GPM", 1, 5, 2), ("GPM", 5, 5, 1), ("TRMM", 1, 5, 1)]
    lake.write_features(features(spark, ("GPM", 1, 1, T0 + dt.timedelta(days=1))), root)
    assert index_of(spark, root) == [("GPM", 1, 6, 1), ("GPM", 5, 5, 1), ("TRMM", 1, 5, 1)]
    lake.write_features(features(spark, ("GPM", 1, 1, T0)).limit(0), root)
    assert len(index_of(spark, root)) == 3


def test_table_without_an_index(spark, tmp_path):
    """An older table gets its index on the next write, and an orbit that moves then is found once."""
    import shutil

    root = str(tmp_path)
    lake.write_features(features(spark, ("GPM", 1, 1, T0), ("GPM", 2, 1, T0)), root)
    shutil.rmtree(f"{root}/orbit_index")
    lake.write_features(features(spark, ("GPM", 1, 1, T0 + dt.timedelta(days=1))), root)
    assert index_of(spark, root) == [("GPM", 1, 6, 1), ("GPM", 2, 5, 1)]
    assert lake.read_table(spark, root, "features").count() == 2


def test_input_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = features(spark, ("GPM", 1, 1, T0), ("GPM", 2, 1, T0))
    lake.write_features(df.mapInArrow(count, df.schema), str(tmp_path))
    assert seen.value == 2


def test_window_reads_its_months_only(spark, tmp_path):
    root = str(tmp_path)
    rows = [("GPM", k, 1, dt.datetime(2019 + k // 12, k % 12 + 1, 28, 23)) for k in range(30)]
    lake.write_features(features(spark, *rows), root)
    table = lake.read_table(spark, root, "features")
    start, end = "2020-02-01", "2020-03-01"
    for found in (lake.scan_features(table, "gpm", start, end, ["orbit"]), lake.features_for_orbits_starting(table, start, end)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
        assert "year#" in line.split("PartitionFilters")[1].split("PushedFilters")[0] and "month#" in line
        assert [r.orbit for r in found.collect()] == [13]
    near = lake.read_months(spark, root, "features", "gpm", start, end)
    assert sorted(r.orbit for r in near.collect()) == [12, 13, 14, 15] and near.columns == table.columns
    assert len(near.inputFiles()) == 4
    assert lake.read_months(spark, root, "features", "trmm", start, end).count() == 0


def months_of(df):
    return sorted((r.year, r.month, r.source_rows, r.target_rows, r.status) for r in df.collect())


def test_compaction_sees_changed_contents(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    first = features(spark, ("GPM", 1, 1, T0), ("GPM", 2, 1, T0), ("GPM", 3, 1, T0 + dt.timedelta(days=40))).withColumn("npixels", F.lit(5))
    lake.write_features(first, src)
    assert months_of(lake.compact(spark, src, dst, "features")) == [(2020, 5, 2, 2, "ok"), (2020, 7, 1, 1, "ok")]
    assert months_of(lake.compact(spark, src, dst, "features")) == [(2020, 5, 2, 2, "skip"), (2020, 7, 1, 1, "skip")]
    lake.write_features(first.where("orbit = 1").withColumn("npixels", F.lit(6)), src)  # as many rows
    lake.write_features(first.where("orbit = 3").withColumn("time", F.lit(T0 + dt.timedelta(days=3))), src)  # July is empty now
    assert months_of(lake.compact(spark, src, dst, "features")) == [(2020, 5, 2, 2, "ok"), (2020, 6, 1, 1, "ok"), (2020, 7, None, 1, "removed")]
    got = sorted((r.orbit, r.month, r.npixels) for r in lake.read_table(spark, dst, "features", granule=False).collect())
    assert got == [(1, 5, 6), (2, 5, 5), (3, 6, 5)]
    assert {r[-1] for r in months_of(lake.compact(spark, src, dst, "features", verify=True))} == {"skip"}


def test_compaction_finds_a_damaged_target(spark, tmp_path):
    import shutil

    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    lake.write_features(features(spark, ("GPM", 1, 1, T0), ("GPM", 2, 1, T0 + dt.timedelta(days=3))), src)
    lake.compact(spark, src, dst, "features")
    shutil.rmtree(f"{dst}/features/mission=GPM/year=2020/month=6")
    assert {r[-1] for r in months_of(lake.compact(spark, src, dst, "features"))} == {"skip"}
    assert [r[-1] for r in months_of(lake.compact(spark, src, dst, "features", verify=True))] == ["skip", "ok"]
    assert lake.read_table(spark, dst, "features", granule=False).count() == 2


def test_month_run_again_without_rain(spark, tmp_path):
    root = str(tmp_path)
    months = spark.createDataFrame([("GPM", 2020, 5), ("GPM", 2020, 6)], "mission string, year int, month int")
    names = [f.name for f in lake.TABLES["grid_rain"].fields]
    rain = months.select("*", *[F.lit(1).alias(c) for c in names])
    report = months.withColumn("n_rain", F.lit(1))
    lake.write_grid(rain, root, "rain", months)
    lake.write_report(report, root)
    lake.write_grid(rain.limit(0), root, "rain", months.where("month = 6"))
    lake.write_report(report.where("month = 6").withColumn("n_rain", F.lit(0)), root)
    assert [r.month for r in lake.read_table(spark, root, "grid_rain", granule=False).collect()] == [5]
    assert sorted((r.month, r.n_rain) for r in spark.read.parquet(f"{root}/processed_months").collect()) == [(5, 1), (6, 0)]
