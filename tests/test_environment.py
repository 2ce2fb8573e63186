import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rainloom.operators import environment as env
from rainloom.schemas import env_columns

HOUR = dt.datetime(1997, 12, 30, 22)


@pytest.fixture(scope="module")
def reanalysis(spark):
    cells = spark.range(33 * 33).select(
        F.lit(HOUR).alias("hour"), (F.lit(-108) + F.col("id") / 33).cast("int").alias("iy"), (F.lit(1196) + F.col("id") % 33).cast("int").alias("ix")
    )
    level = F.transform(
        F.array(*[F.lit(x) for x in (400, 500, 600, 700, 850, 925, 1000)]),
        lambda p: F.struct(
            p.cast("double").alias("level"),
            (F.element_at(F.create_map(*[F.lit(v) for kv in {400: 7000.0, 500: 5500.0, 600: 4200.0, 700: 3000.0, 850: 1500.0, 925: 800.0, 1000: 100.0}.items() for v in kv]), p) * 9.81).alias("z"),
            (F.element_at(F.create_map(*[F.lit(v) for kv in {400: 7000.0, 500: 5500.0, 600: 4200.0, 700: 3000.0, 850: 1500.0, 925: 800.0, 1000: 100.0}.items() for v in kv]), p) * 0.002).alias("u"),
            F.lit(5.0).alias("v"),
        ),
    )
    return cells.withColumns({
        "cape": F.lit(1000.0), "cin": F.lit(-50.0), "sst": F.lit(300.0), "skt": F.lit(301.0), "tpr": F.lit(0.002),
        "u10": F.lit(1.0), "v10": F.lit(2.0), "levels": level,
    })


def features(spark, *places):
    rows = [(i + 1, "TRMM", 61218, t, la, lo) for i, (t, la, lo) in enumerate(places)]
    return spark.createDataFrame(rows, "feature_id long, mission string, orbit int, time timestamp, centroid_lat double, centroid_lon double")


def test_shear_of_linear_profile(reanalysis):
    row = env.shear(reanalysis).first()
    for h in (1000, 3000, 6000):
        assert row[f"shear_{h}m"] == pytest.approx(math.hypot(0.002 * h - 1, 3.0))
    low = reanalysis.withColumn("levels", F.filter("levels", lambda x: x["level"] > 600))
    assert env.shear(low).first()["shear_6000m"] is None
    single = reanalysis.withColumn("levels", F.filter("levels", lambda x: x["level"] == 700))
    assert env.shear(single).first()["shear_3000m"] is None


def test_box_of_known_pattern(spark, reanalysis):
    iy, ix = F.col("iy"), F.col("ix")
    cells = env.shear(reanalysis).withColumn("cape", (iy * 1000 + ix).cast("double"))
    cells = cells.withColumn("cape", F.when(~((iy == -92) & (ix == 1208)), F.col("cape")))
    row = env.box_stats(features(spark, (HOUR, -23.0, -57.0)), cells, ("cape",)).first()
    values = sorted(y * 1000 + x for y in range(-102, -81) for x in range(1202, 1223) if (y, x) != (-92, 1208))
    assert len(values) == 440
    assert row.min_cape_5deg == values[0] and row.max_cape_5deg == values[-1]
    assert row.mean_cape_5deg == pytest.approx(sum(values) / 440)
    mean = sum(values) / 440
    assert row.std_cape_5deg == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 440))
    spot = 0.9 * 439
    assert row.p90_cape_5deg == pytest.approx(values[int(spot)] + (values[int(spot) + 1] - values[int(spot)]) * (spot - int(spot)))
    small = sorted(y * 1000 + x for y in range(-95, -88) for x in range(1209, 1216))
    assert (row.min_cape_1p25deg, row.max_cape_1p25deg) == (small[0], small[-1])


def test_table_keeps_features_without_analysis(spark, reanalysis):
    f = features(spark, (HOUR + dt.timedelta(minutes=20), -23.1, -57.0), (HOUR + dt.timedelta(hours=5), -23.0, -57.0))
    rows = env.env_for_features(f, reanalysis).orderBy("feature_id").collect()
    assert len(rows) == 2 and len(rows[0]) == 252 and list(rows[0].asDict())[4:] == env_columns()
    assert rows[0].cape_centroid == 1000.0 and rows[0].std_skt_2p50deg == 0.0
    assert all(rows[1][c] is None for c in env_columns())


def test_boxes_wrap_and_stop_at_the_pole(spark):
    centres = spark.createDataFrame([(HOUR, 358, 1439)], "hour timestamp, iy int, ix int")
    cells = env.box_cells(centres, 3)
    assert cells.count() == 6 * 7  # rows 355..360
    assert {r.ix for r in cells.select("ix").distinct().collect()} == {1436, 1437, 1438, 1439, 0, 1, 2}


def test_longitude_above_the_last_cell_wraps(spark):
    row = env.locate(features(spark, (HOUR, 0.0, -0.05))).first()
    assert (row.iy, row.ix) == (0, 0)
