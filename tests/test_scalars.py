import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions import scalars as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_class_edges(spark):
    size = [5.0, 20.0, 49.9, 50.0, 100.0, 200.0, None, float("inf"), float("nan")]
    assert column(spark, size, S.size_class("x")) == [0, 1, 1, 2, 3, 3, 4, 4, 4]
    top = [4000.0, 5000.0, 7400.0, 7500.0, 12000.0, 15000.0, None]
    assert column(spark, top, S.echotop_class("x")) == [0, 1, 1, 2, 3, 3, 4]
    assert column(spark, [1, 2, 3, 0, -1], S.raintype_class("x"), "int") == [0, 1, 2, None, None]


def test_surface_class(spark):
    assert column(spark, [0, 99, 100, 199, 200, 399, -1, None], S.surface_class("x"), "int") == [0, 0, 1, 1, 2, 2, -1, -1]


def test_grid_bins_wrap_and_clip(spark):
    lon = column(spark, [180.02, -179.98, 540.02], S.lon_bin("x"))
    assert lon[0] == lon[1] == lon[2] == 0
    assert column(spark, [-90.0, 90.0, 0.02], S.lat_bin("x")) == [0, 3599, 1800]
    assert S.lat_clip_bins("GPM") == (440, 3160)
    assert S.lat_clip_bins("TRMM") == (1040, 2560)


def test_fill_values(spark):
    raw = [-9999.9, -9999.0, -99.0, -1111.1, 5.0, float("nan"), None]
    assert column(spark, raw, S.decode_fill("x")) == [None, None, None, None, 5.0, None, None]
    assert column(spark, raw, S.decode_fill("x", C.GEO_FILL_SENTINELS))[2] == -99.0


def test_rain_type_of_negative_code(spark):
    assert column(spark, [-9999, 12345678, 20000000, 30000001], S.rain_type("x"), "int") == [-1, 1, 2, 3]


def test_slant_height(spark):
    nadir, edge, fill = (
        one(spark, S.bin_heights(F.lit(z).cast("double")).alias("h")).h[0] for z in (0.0, 18.0, -9999.0)
    )
    assert nadir == fill == 175 * 125.0
    assert edge == pytest.approx(175 * 125.0 * 0.9510565163)


def test_scan_time(spark):
    lit = [F.lit(v) for v in (2018, 6, 15, 1, 2, 3, 456)]
    assert one(spark, S.scan_time(*lit).alias("t")).t == dt.datetime(2018, 6, 15, 1, 2, 3, 456000)
    bad = [F.lit(-9999), *lit[1:]]
    assert one(spark, S.scan_time(*bad).alias("t")).t is None


def test_feature_id_round_trip_and_range(spark):
    fid = S.encode_feature_id(F.lit("gpm"), F.lit(12345), F.lit(7))
    row = one(spark, fid.alias("f"), S.decode_feature_id(fid).alias("d"))
    assert row.f == 2 * 10**13 + 12345 * 10**5 + 7
    assert tuple(row.d) == ("GPM", 12345, 7)
    for bad in ((F.lit("GPM"), F.lit(100000), F.lit(1)), (F.lit("GPM"), F.lit(1), F.lit(0)), (F.lit("XYZ"), F.lit(1), F.lit(1))):
        with pytest.raises(Exception, match="out of range"):
            one(spark, S.encode_feature_id(*bad).alias("f"))


def test_pct(spark):
    v = one(spark, S.pct(F.lit(274.1), F.lit(257.2), *C.PCT_85_89).alias("p")).p
    assert v == pytest.approx(1.818 * 274.1 - 0.818 * 257.2)
    assert one(spark, S.pct(F.lit(None).cast("double"), F.lit(257.2), *C.PCT_37).alias("p")).p is None


def test_nearest_hour_half_even(spark):
    times = ["2020-01-01 00:30:00", "2020-01-01 01:30:00", "2020-01-01 01:30:00.000001", "2020-01-01 02:29:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.hour(S.nearest_hour(F.col("t").cast("timestamp"))).alias("h"))
    assert [r.h for r in df.collect()] == [0, 2, 2, 2]


def test_local_solar_hour(spark):
    at = F.lit("2020-01-01 23:30:00").cast("timestamp")
    assert one(spark, S.local_solar_hour(at, F.lit(30.0)).alias("h")).h == 1
    assert one(spark, S.local_solar_hour(F.lit("2020-01-01 01:00:00").cast("timestamp"), F.lit(-45.0)).alias("h")).h == 22
    # whole-hour shift of a cell: half-even rounding of lon / 15
    assert one(spark, S.local_hour_of_cell(F.lit(0), F.lit(-7.5)).alias("h")).h == 0
    assert one(spark, S.local_hour_of_cell(F.lit(0), F.lit(22.5)).alias("h")).h == 2


def test_gate_value_out_of_range(spark):
    arr = F.array(F.lit(1.0), F.lit(2.0))
    got = one(spark, *[S.gate_value(arr, F.lit(i)).alias(f"g{i + 1}") for i in (-1, 0, 1, 2)])
    assert tuple(got) == (None, 1.0, 2.0, None)


def test_population_of_missing_fraction_is_coast(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.population(null, null).alias("p")).p == "coast"


def test_missing_position_stays_missing(spark):
    null = F.lit(None).cast("double")
    row = one(spark, S.haversine_km(null, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("d"), S.lat_bin(null).alias("y"), S.lon_bin(null).alias("x"))
    assert tuple(row) == (None, None, None)
