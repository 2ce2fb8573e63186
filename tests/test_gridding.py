import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainloom.operators import gridding, labels, features, validate
from rainloom.plans import climatology as cl
from rainloom.plans import grid_views as gv

UTC = dt.datetime


def test_hours_and_month_edge(make_swath, spark):
    swath = make_swath(2, 10, per_scan={0: {"time": UTC(2020, 5, 31, 23, 30)}, 1: {"time": UTC(2020, 6, 1, 0, 30)}})
    hours = {r.hour: r.n for r in gridding.hour_views(swath).groupBy("hour").agg(F.sum("n_views").alias("n")).collect()}
    assert hours == {23: 10, 0: 10}
    months = gridding.grid_months(swath, None, None, metrics_only=True)
    assert list(months) == ["metrics"]
    none = swath.select("mission", "orbit", "scan", "ray").limit(0).withColumn("local_label", F.lit(1))
    feats = spark.createDataFrame([], "mission string, orbit int, local_label int, major_axis_km float, max_ht_20dbz float")
    views = gridding.grid_months(swath, none, feats)["views"]
    assert {(r.year, r.month): r.n for r in views.groupBy("year", "month").agg(F.sum("n_views").alias("n")).collect()} == {(2020, 5): 10, (2020, 6): 10}
    june = gridding.hour_views(swath, ("2020-06-01", "2020-07-01"))
    assert june.agg(F.sum("n_views")).first()[0] == 10


def test_view_rule(make_swath):
    swath = make_swath(1, 4, {(0, 0): {"near_sfc_rain": 0.0}, (0, 1): {"near_sfc_rain": None}, (0, 2): {"near_sfc_rain": 5.0}, (0, 3): {"lat": None}})
    assert gridding.orbit_views(swath).agg(F.sum("n_views")).first()[0] == 2


def test_same_cell_and_undefined_class(make_swath):
    spot = {"lat": 10.02, "lon": 100.03, "rain_type": 2}
    swath = make_swath(1, 4, {
        (0, 0): {**spot, "near_sfc_rain": 2.0}, (0, 1): {**spot, "near_sfc_rain": 5.0},
        (0, 2): {**spot, "near_sfc_rain": 0.0}, (0, 3): {**spot, "near_sfc_rain": 1.0, "rain_type": -1},
    })
    lab = labels.label_features(swath)
    rain = gridding.hour_rain(swath, lab, features.build_features(swath, lab)).collect()
    assert [(r.rain_sum, r.raining_count, r.size_class, r.echotop_class, r.raintype) for r in rain] == [(7.0, 2, 4, 4, 1)]
    assert gridding.hour_views(swath).first().n_views == 4


def test_month_partition(spark):
    feats = spark.createDataFrame([(100, 30.0, 6000.0)], "feature_id long, major_axis_km float, max_ht_20dbz float")
    pix = spark.createDataFrame([(100, 0.02, 0.03, r, 2) for r in (2.0, 4.0, 6.0)], "feature_id long, lat float, lon float, near_sfc_rain float, rain_type short")
    views = spark.createDataFrame([(1800, 3600, 10)], "lat_bin short, lon_bin short, n_views int")
    joint = gridding.accumulate_month(pix, feats)
    row = joint.first()
    assert (row.lat_bin, row.lon_bin, row.size_class, row.echotop_class, row.raintype, row.rain_sum, row.raining_count) == (1800, 3600, 1, 1, 1, 12.0, 3)
    rate = gridding.combine(gridding.reduce_views(views).select("lat_bin", "lon_bin", F.lit(12.0).alias("rain_sum")), gridding.reduce_views(views), ["lat_bin", "lon_bin"])
    assert rate.select(F.col("rain_sum") / F.col("n_views")).first()[0] == pytest.approx(1.2)


def test_metrics_split_and_drop(make_swath):
    swath = make_swath(1, 3, {
        (0, 0): {"rain_type": 2, "near_sfc_rain": 60.0, "epsilon": 1.0, "dm": 1.5, "bins": {135: 35.0}},
        (0, 1): {"rain_type": 1, "near_sfc_rain": 10.0, "epsilon": 0.5, "lat": 40.0},
        (0, 2): {"lat": -40.0},
    })
    got = {r.lat_bin: r for r in gridding.hour_metrics(swath).collect()}
    assert set(got) == {2000, 2600}
    conv, strat = got[2000], got[2600]
    assert (conv.et20_sum, conv.et20_n, conv.et30_n, conv.et40_n, conv.cnt_gt25, conv.cnt_gt50, conv.cnt_gt75) == (5000.0, 1, 1, 0, 1, 1, 0)
    assert (conv.eps_conv_sum, conv.eps_conv_n, conv.eps_strat_n, conv.dm_conv_n) == (1.0, 1, 0, 1)
    assert (strat.eps_strat_sum, strat.eps_conv_n, strat.et20_n) == (0.5, 0, 0)


def test_conservation_check(make_swath, spark):
    swath = make_swath(3, 6)
    views = gridding.hour_views(swath)
    rain = spark.createDataFrame([("GPM", 0, 0, 0, 1)], "mission string, lat_bin short, lon_bin short, hour byte, raining_count long")
    assert validate.check_conservation(swath, views, rain.limit(0)).isEmpty()
    assert [r.problem for r in validate.check_conservation(swath, views, rain).collect()] == ["rain without view"]
    assert "total" in {r.problem for r in validate.check_conservation(swath, views.withColumn("n_views", F.col("n_views") * 2), rain).collect()}


def test_densify_has_every_cell(spark):
    grid = spark.createDataFrame([(3, 20, 30, 7)], "month int, lat_bin short, lon_bin short, n_views long")
    out = gridding.densify(grid, ["n_views"], {"month": [2, 3]}, (0.0, 40.0), (-60.0, 0.0), 4.0)
    # latitudes 0..40 in 4-degree bins, both ends included; 15 columns of longitude; 2 months
    assert out.count() == 11 * 15 * 2
    assert out.agg(F.sum("n_views")).first()[0] == 0
    inside = grid.withColumn("lat_bin", F.lit(25).cast("short")).withColumn("lon_bin", F.lit(31).cast("short"))
    assert gridding.densify(inside, ["n_views"], {"month": [2, 3]}, (0.0, 40.0), (-60.0, 0.0), 4.0).agg(F.sum("n_views")).first()[0] == 7


def test_combined_member_pools_totals(spark):
    totals = spark.createDataFrame([("GPM", 1000, 5, 10.0, 2, 20), ("TRMM", 1000, 5, 2.0, 1, 4), ("TRMM", 100, 5, 9.0, 9, 9)],
                                   "mission string, lat_bin short, lon_bin short, rain_sum double, raining long, n_views long")
    got = {r.member: (r.rain_sum, r.n_views) for r in cl.pooled_members(totals).collect()}
    assert got == {"GPM": (10.0, 20), "TRMM": (2.0, 4), "COMBINED": (12.0, 24)}


def test_quantity_masks(spark):
    zero = {c: 0 for c in ("conv_rain_sum", "conv_raining", "strat_rain_sum", "strat_raining")}
    rows = [("GPM", 1, 1, 5.0, 2, 9), ("GPM", 2, 1, 5.0, 2, 10), ("GPM", 3, 1, 0.0, 0, 10)]
    t = spark.createDataFrame(rows, "member string, lat_bin int, lon_bin int, rain_sum double, raining long, n_views long").withColumns({k: F.lit(v) for k, v in zero.items()})
    got = {r.lat_bin: r for r in cl.derive_quantities(t).collect()}
    assert got[1].rate is None and got[1].intensity == 2.5 and got[1].views == 9
    assert got[2].rate == 0.5 and got[2].rain == pytest.approx(0.5 * 8766) and got[2].conv_rain_frac == 0.0
    assert got[3].rate == 0.0 and got[3].intensity is None and got[3].conv_rain_frac is None


def test_coarsen_trims_and_conserves(spark):
    grid = spark.range(7 * 8).select((F.col("id") / 8).cast("int").alias("lat_bin"), (F.col("id") % 8).cast("int").alias("lon_bin"), F.lit(1).alias("n"))
    # 45-degree cells: rows 0..3 exist, columns 0..7
    out = gv.coarsen(grid.where("lat_bin < 4"), 3, ["n"], band=(-90.0, 89.0), deg=45.0)
    assert {(r.row, r.col): r.n for r in out.collect()} == {(0, 0): 9, (0, 1): 9}


def test_peak_hour_first_on_tie(spark):
    views = spark.createDataFrame([(0, 180, h, 10) for h in range(24)], "lat_bin int, lon_bin int, hour int, n_views long")
    rain = spark.createDataFrame([(0, 180, 6, 5.0, 1), (0, 180, 9, 5.0, 1)], "lat_bin int, lon_bin int, hour int, rain_sum double, raining_count long")
    assert gv.peak_hour_map(rain, views, deg=1.0).first().peak_lst == 6
    assert gv.peak_hour_map(rain, views, deg=1.0, min_rain=0.05).isEmpty()
