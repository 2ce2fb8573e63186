import datetime as dt

from pyspark.sql import functions as F

from rainloom.sources import granules as gr
from rainloom.sources import lake

TRMM = "2A.TRMM.PR.V9-20220125.19971230-S225350-E002507.061218.V07A.HDF5"
GPM = "/data/2A.GPM.Ku.V9-20220125.20180615-S010000-E013000.012345.V07A.HDF5"


def parse(spark, *names):
    return gr.parse_granules(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq int, name string"))


def test_orbit_crossing_midnight(spark):
    a, b, c = parse(spark, TRMM, GPM, "readme.txt").orderBy("seq").collect()
    assert (a.orbit, a.version) == (61218, "07A")
    assert (a.obs_start, a.obs_end) == (dt.datetime(1997, 12, 30, 22, 53, 50), dt.datetime(1997, 12, 31, 0, 25, 7))
    assert (b.orbit, b.obs_start, b.obs_end) == (12345, dt.datetime(2018, 6, 15, 1), dt.datetime(2018, 6, 15, 1, 30))
    assert (c.orbit, c.version, c.obs_start, c.obs_end) == (None, None, None, None)


def test_end_defaults_to_a_hundred_minutes(spark):
    row = parse(spark, GPM.replace("-E013000", "")).first()
    assert row.obs_end == dt.datetime(2018, 6, 15, 2, 40)


def test_months_of_an_orbit(spark):
    df = spark.createDataFrame(
        [(1, "2020-05-31 23:30:00", "2020-06-01 00:30:00"), (2, "2020-05-31 22:00:00", "2020-06-01 00:00:00"), (3, None, None)],
        "seq int, s string, e string",
    ).select("seq", F.col("s").cast("timestamp").alias("obs_start"), F.col("e").cast("timestamp").alias("obs_end"))
    got = sorted((r.seq, r.month or 0) for r in gr.granule_months(df).collect())
    assert got == [(1, 5), (1, 6), (2, 5), (3, 5), (3, 6)]
    got = sorted((r.seq, r.month) for r in gr.granule_months(df.where("seq = 3"), ("2019-12-15", "2020-01-02")).collect())
    assert got == [(3, 1), (3, 12)]
    assert [r.month for r in gr.granule_months(df.where("seq = 3")).collect()] == [None]


def test_version_preference_falls_back(spark):
    rows = [("GPM_2ADPR", "a.V07A.h5"), ("GPM_2ADPR", "b.V08A.h5"), ("GPM_1CGPMGMI", "c.V07A.h5"), ("other", "d.V07B.h5"), ("other", "e.V06B.h5")]
    df = spark.createDataFrame(rows, "product string, name string")
    assert sorted(r.name for r in gr.prefer_version(df, by=()).collect()) == ["a.V07A.h5", "c.V07A.h5", "d.V07B.h5"]


def test_version_preference_is_per_orbit(spark):
    """An orbit that exists in another version only stays, whatever other orbits have."""
    rows = [(1, "x.V07A.h5"), (1, "x.V08A.h5"), (2, "y.V08A.h5"), (None, "z.V08A.h5")]
    df = spark.createDataFrame(rows, "orbit int, name string").selectExpr("'GPM_2ADPR' AS product", "'GPM' AS mission", "*")
    assert sorted(r.name for r in gr.prefer_version(df).collect()) == ["x.V07A.h5", "y.V08A.h5", "z.V08A.h5"]


def test_last_granule_of_an_orbit(spark):
    df = spark.createDataFrame([(1, "GPM", 5), (2, "GPM", 5), (3, "GPM", None), (4, "TRMM", 5)], "seq int, mission string, orbit int")
    assert sorted(r.seq for r in gr.one_per_orbit(df).collect()) == [2, 4]


def test_run_report(spark):
    inv = spark.createDataFrame([("GPM", 1, True), ("GPM", 2, True), ("GPM", 3, False), ("GPM", 4, True)], "mission string, orbit int, has_radar boolean")
    one = spark.createDataFrame([("GPM", 1)], "mission string, orbit int")
    views = spark.createDataFrame([("GPM", 1), ("GPM", 2)], "mission string, orbit int")
    got = {r.orbit: r.status for r in lake.run_report(inv, one, one, views).collect()}
    assert got == {1: "ok", 2: "empty", 3: "skipped_no_radar", 4: "failed"}
