import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rainloom import schemas
from rainloom.operators import features, labels, validate
from rainloom.sources import lake

A = [(4, 4), (4, 5), (5, 4), (5, 5), (6, 4)]
B = [(10, 10), (10, 11), (11, 10), (11, 11), (12, 10), (12, 11)]
DBZ = [22.0, 24.0, 41.0, 33.0, 28.0]


@pytest.fixture(scope="module")
def tables(make_swath):
    px = {}
    for i, c in enumerate(A):
        px[c] = {"near_sfc_dbz": DBZ[i], "near_sfc_rain": 2.0, "rain_type": 2 if i < 2 else 1, "surface_type": 10 if i < 2 else 150}
    for c in B:
        px[c] = {"near_sfc_dbz": 30.0, "near_sfc_rain": 3.0, "rain_type": 1, "surface_type": -1}
    px[(5, 4)]["bins"] = {175 - 40: 45.0}
    px[(6, 4)].update(pct_85_89=180.0, bb_height=4500.0)
    swath = make_swath(16, 16, px)
    lab = labels.label_features(swath).cache()
    return swath, lab, features.build_features(swath, lab).cache(), features.build_pixels(swath, lab).cache()


def test_schemas(tables):
    _, _, feats, pixels = tables
    assert len(schemas.FEATURES) == 58 and len(schemas.PIXELS) == 14 and len(schemas.ENV) == 252
    assert validate.check_schema(feats, schemas.FEATURES).isEmpty()
    assert validate.check_schema(pixels, schemas.PIXELS).isEmpty()


def test_feature_row(tables):
    a, b = tables[2].orderBy("local_label").collect()
    assert (a.npixels, a.area_km2, a.max_near_sfc_dbz) == (5, 100.0, 41.0)
    assert (a.bbox_scan_min, a.bbox_scan_max, a.bbox_ray_min, a.bbox_ray_max) == (4, 6, 4, 5)
    assert (a.conv_area_km2, a.strat_area_km2, a.volrain_conv, a.volrain_strat) == (40.0, 60.0, 80.0, 120.0)
    assert a.conv_rain_frac == pytest.approx(0.4) and a.strat_area_frac == pytest.approx(0.6)
    assert (a.max_ht_20dbz, a.max_ht_40dbz, a.max_ht_40dbz_scan, a.max_ht_40dbz_ray) == (5000.0, 5000.0, 5, 4)
    assert a.surface_flag == 1 and a.frac_land == pytest.approx(0.6)
    assert (a.feature_class, a.is_mcs, a.edge) == ("sub_MCS_conv", False, False)
    assert (a.min_pct_85_89, a.min_pct_37, a.mean_bb_height) == (180.0, None, 4500.0)
    # mean member scan: (4 + 4 + 5 + 5 + 6) / 5 seconds
    assert a.time == dt.datetime(2020, 6, 1, 0, 0, 4, 800000)
    assert (b.surface_flag, b.frac_land, b.feature_class) == (-1, None, "stratiform_only")
    assert b.max_ht_20dbz is None and b.ray_obs_ceiling_m is None


def test_pixels_belong_to_features(tables):
    _, _, feats, pixels = tables
    assert pixels.count() == 11
    assert validate.integrity_violations(pixels, feats).isEmpty()
    assert validate.check_ranges(feats).isEmpty()
    assert not validate.integrity_violations(pixels.where("scan <> 4"), feats).isEmpty()


def members(spark, points):
    rows = [("GPM", 1, 1, i, i, float(la), float(lo), 20.0) for i, (la, lo) in enumerate(points)]
    return spark.createDataFrame(
        rows, "mission string, orbit int, local_label int, scan int, ray int, lat double, lon double, pixel_area double"
    )


def test_across_the_antimeridian(spark):
    m = members(spark, [(0, 179.9), (0, -179.95), (0, 179.95), (0, -179.9)])
    c = features.feature_centroid(m).first()
    assert abs(abs(c.centroid_lon) - 180) < 1e-6
    b = features.feature_bbox(m).first()
    assert (b.bbox_lon_min, b.bbox_lon_max) == (pytest.approx(179.9), pytest.approx(-179.9))
    assert features.feature_axes(m).first().major_axis_km == pytest.approx(4 * 111.195 * math.sqrt((0.1**2 + 0.05**2) / 2), rel=1e-4)


@pytest.mark.parametrize("points,angle", [([(0, 0), (0, 1), (0, 2)], 0.0), ([(0, 0), (1, 0), (2, 0)], 90.0), ([(0, 0), (1, 1), (2, 2)], 45.0)])
def test_orientation(spark, points, angle):
    row = features.feature_axes(members(spark, points)).first()
    assert row.orientation_deg == pytest.approx(angle, abs=0.02)
    assert row.aspect_ratio == pytest.approx(1e4)


def test_single_pixel_shape(spark):
    row = features.feature_axes(members(spark, [(10, 20)])).first()
    assert (row.major_axis_km, row.minor_axis_km, row.orientation_deg, row.aspect_ratio) == (0.0, 0.0, 0.0, 1.0)
    assert features.feature_thin(members(spark, [(10, 20)])).first().is_thin


def test_no_weight_gives_no_centroid(spark):
    m = members(spark, [(1, 1), (2, 2)]).withColumn("pixel_area", F.lit(0.0))
    assert tuple(features.feature_centroid(m).first())[3:] == (None, None)


def test_lake_round_trip(tables, spark, tmp_path, capsys):
    _, _, feats, pixels = tables
    root = str(tmp_path / "lake")
    assert lake.read_table(spark, root, "features").count() == 0
    lake.write_features(feats, root)
    lake.write_pixels(pixels, feats, root)
    other = feats.withColumn("orbit", F.lit(12346)).withColumn("feature_id", F.col("feature_id") + 100000)
    lake.write_features(other, root)
    lake.write_features(feats.where("npixels = 5"), root)
    back = lake.read_table(spark, root, "features", "gpm", [6])
    assert sorted((r.orbit, r.npixels) for r in back.collect()) == [(12345, 5), (12346, 5), (12346, 6)]
    assert (tmp_path / "lake/features/mission=GPM/year=2020/month=6/granule=012345").is_dir()
    assert back.where("month = 6").first().time.year == 2020
    capsys.readouterr()
    back.select("area_km2").where("time > timestamp'2020-06-01'").explain("formatted")
    plan = capsys.readouterr().out
    assert "isnotnull(month" in plan and "PushedFilters: [IsNotNull(time)" in plan
    assert "ReadSchema: struct<time:timestamp,area_km2:float>" in plan

    report = lake.compact(spark, root, str(tmp_path / "small"), "features").collect()
    assert [(r.source_rows, r.target_rows, r.status) for r in report] == [(3, 3, "ok")]
    again = lake.compact(spark, root, str(tmp_path / "small"), "features").collect()
    assert [r.status for r in again] == ["skip"]
    ids = [r.feature_id for r in lake.read_table(spark, str(tmp_path / "small"), "features", granule=False).collect()]
    assert ids == sorted(ids)


def test_orbits_by_start(spark):
    rows = [(1, "2020-01-01 23:50:00"), (1, "2020-01-02 00:40:00"), (2, "2020-01-02 01:00:00"), (2, "2020-01-02 02:10:00"), (3, "2020-01-03 00:00:00")]
    f = spark.createDataFrame(rows, "orbit int, t string").select(F.lit("GPM").alias("mission"), "orbit", F.col("t").cast("timestamp").alias("time"))
    got = [r.orbit for r in lake.features_for_orbits_starting(f, "2020-01-02", "2020-01-03").collect()]
    assert got == [2, 2]
    assert [r.orbit for r in lake.features_for_orbits_starting(f, "2020-01-01", "2020-01-02").collect()] == [1, 1]
