import math
import random

import pytest
from pyspark.sql import functions as F

from rainloom.operators import colocate


def sphere_km(a, b):
    (la1, lo1), (la2, lo2) = a, b
    p1, p2 = math.radians(la1), math.radians(la2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 12742.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("where", ["equator", "seam", "pole"])
def test_nearest_matches_brute_force(spark, where):
    rng = random.Random(where)
    lat0, lon0 = {"equator": (0.0, 20.0), "seam": (35.0, 180.0), "pole": (89.6, 0.0)}[where]
    spread = 180.0 if where == "pole" else 0.6

    def point():
        lon = lon0 + rng.uniform(-spread, spread)
        return min(89.99, lat0 + rng.uniform(-0.35, 0.35)), (lon + 180.0) % 360.0 - 180.0

    src = [point() for _ in range(150)]
    src += src[:30]  # copies: the first one must win
    tgt = [point() for _ in range(120)]
    sources = spark.createDataFrame([("GPM", 1, i, 0, la, lo, float(i)) for i, (la, lo) in enumerate(src)],
                                    "mission string, orbit int, scan int, ray int, lat double, lon double, pct double")
    targets = spark.createDataFrame([("GPM", 1, i, 0, la, lo) for i, (la, lo) in enumerate(tgt)],
                                    "mission string, orbit int, scan int, ray int, lat double, lon double")
    got = {r.scan: (int(r.pct), r.distance_km) for r in colocate.nearest_within(targets, sources, "pct").collect()}
    want = {}
    for i, t in enumerate(tgt):
        d, j = min((sphere_km(t, s), j) for j, s in enumerate(src))
        if d <= 15.0:
            want[i] = (j, d)
    assert set(got) == set(want)
    for i, (j, d) in want.items():
        assert got[i][1] == pytest.approx(d, rel=1e-6)
        assert got[i][0] == j


def imager(spark, n_scan=6, n_ray=5, ahead=1.0):
    rows = [
        ("GPM", 1, "37", s, r, s * 0.1, r * 0.1, 100.0 + s * 10 + r, s * 0.1 + ahead, 0.2)
        for s in range(n_scan)
        for r in range(n_ray)
    ]
    return spark.createDataFrame(
        rows, "mission string, orbit int, channel string, scan int, ray int, lat double, lon double, pct double, sc_lat double, sc_lon double"
    )


@pytest.mark.parametrize("ahead,shift,edge", [(1.0, -1, 5), (-1.0, 1, 0)])
def test_parallax_direction_and_edge_row(spark, ahead, shift, edge):
    im = imager(spark, ahead=ahead)
    assert colocate.parallax_direction(im).first()["shift"] == shift
    got = {r.scan: r.lat for r in colocate.parallax_shift(im).where("ray = 2").collect()}
    for s in range(6):
        want = s if s == edge else s - shift
        assert got[s] == pytest.approx(want * 0.1)


def test_two_scans_default_direction(spark):
    assert colocate.parallax_direction(imager(spark, n_scan=2, ahead=-1.0)).first()["shift"] == -1


def test_gate_picks_shifted_value(spark):
    im = imager(spark)
    rows = [("GPM", 1, 3, 2, 0.3, 0.2, 6000.0, 0.5), ("GPM", 1, 3, 3, 0.3, 0.3, 6000.0, 0.4), ("GPM", 1, 0, 0, 5.0, 5.0, 0.0, 0.0)]
    swath = spark.createDataFrame(rows, "mission string, orbit int, scan int, ray int, lat double, lon double, storm_top double, pia double")
    got = {(r.scan, r.ray): r.pct_37 for r in colocate.colocate_pct(swath, im, ("37",)).collect()}
    # shifted: the data of scan 2 sits at the place of scan 3; the second pixel misses the gate; the third is out of reach
    assert got == {(3, 2): 122.0, (3, 3): 133.0}


def test_channel_order_violation(spark):
    im = imager(spark).withColumns({"tc_v": F.lit(200.0), "tc_h": F.lit(250.0)})
    assert colocate.check_channel_order(im).count() == 1
    assert colocate.check_channel_order(im.withColumn("tc_v", F.lit(260.0))).isEmpty()
