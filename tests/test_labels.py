import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rainloom.operators import geometry, labels


def wet(cells, dbz=30.0):
    return {c: {"near_sfc_dbz": dbz} for c in cells}


def found(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.local_label].add((r.scan, r.ray))
    return dict(out)


BLOB = [(4, 4), (4, 5), (5, 4), (5, 5), (6, 4)]


def test_two_blobs_numbered_by_first_pixel(make_swath):
    swath = make_swath(12, 12, {**wet(BLOB), **wet([(0, 11)], 25.0)})
    got = found(labels.label_features(swath))
    assert got == {1: {(0, 11)}, 2: set(BLOB)}
    # numbering happens before the filter
    assert set(found(labels.label_features(swath, min_pixels=3))) == {2}
    assert set(found(labels.label_features(swath, min_area=50.0))) == {2}


def test_diagonal_neighbours(make_swath):
    swath = make_swath(8, 8, wet([(2, 2), (3, 3)]))
    assert len(found(labels.label_features(swath))) == 1
    assert len(found(labels.label_features(swath, connectivity=1))) == 2


def test_mission_floor(make_swath):
    cells = wet([(1, 1)], 13.0)
    assert found(labels.label_features(make_swath(4, 4, cells))) == {1: {(1, 1)}}
    assert found(labels.label_features(make_swath(4, 4, cells, mission="TRMM"))) == {}


def test_unknown_area_drops_component(make_swath):
    cells = {**wet(BLOB), **wet([(0, 0)])}
    cells[(5, 5)]["pixel_area"] = None
    assert found(labels.label_features(make_swath(12, 12, cells))) == {1: {(0, 0)}}


def test_edge_flag(make_swath):
    swath = make_swath(8, 8, {**wet([(3, 3), (3, 4)]), **wet([(5, 7)])})
    got = {r.local_label: r.edge for r in labels.touches_edge(labels.label_features(swath), swath).collect()}
    assert got == {1: False, 2: True}


def flood(cells, reach):
    """Plain union of neighbours, numbered in row-major order of the first pixel."""
    todo, out, label = set(cells), {}, 0
    for start in sorted(cells):
        if start not in todo:
            continue
        label += 1
        todo.discard(start)
        queue, group = [start], {start}
        while queue:
            s, r = queue.pop()
            for ds in (-1, 0, 1):
                for dr in (-1, 0, 1):
                    n = (s + ds, r + dr)
                    if n in todo and (reach == 2 or abs(ds) + abs(dr) == 1):
                        todo.discard(n)
                        group.add(n)
                        queue.append(n)
        out[label] = group
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
@pytest.mark.parametrize("fill", [0.45])
def test_random_masks_match_flood_fill(spark, fill, connectivity):
    rng = random.Random(int(fill * 100) + connectivity)
    rows, want = [], {}
    for orbit in range(6):
        cells = {(s, r) for s in range(40) for r in range(20) if rng.random() < fill}
        want[orbit] = flood(cells, connectivity)
        rows += [("GPM", orbit, s, r, 30.0, 1.0) for s, r in cells]
    swath = spark.createDataFrame(rows, "mission string, orbit int, scan int, ray int, near_sfc_dbz float, pixel_area float")
    got = defaultdict(lambda: defaultdict(set))
    for r in labels.label_features(swath, connectivity=connectivity).collect():
        got[r.orbit][r.local_label].add((r.scan, r.ray))
    assert {o: dict(v) for o, v in got.items()} == want


def test_long_winding_component(spark):
    # a snake through 120 scans: one component whatever its length
    cells = []
    for s in range(120):
        if s % 2 == 0:
            cells += [(s, r) for r in range(20)]
        else:
            cells.append((s, 19 if s % 4 == 1 else 0))
    rows = [("TRMM", 1, s, r, 30.0, 2.0) for s, r in cells]
    swath = spark.createDataFrame(rows, "mission string, orbit int, scan int, ray int, near_sfc_dbz float, pixel_area float")
    got = labels.label_features(swath, connectivity=1)
    assert got.count() == len(cells)
    assert got.select("local_label").distinct().count() == 1


def test_area_of_regular_grid(make_swath):
    got = {(r.scan, r.ray): r.pixel_area for r in geometry.footprint_area(make_swath(6, 5)).collect()}
    assert len(got) == 30
    # 4.4 km along track; across track it shrinks with the cosine of latitude
    assert got[(0, 0)] == pytest.approx(4.4 * 4.4 * 0.98481, rel=1e-3)
    # single-precision positions limit the agreement
    assert got[(2, 2)] == pytest.approx(got[(2, 0)], rel=1e-3)


def test_area_needs_positions(make_swath):
    swath = make_swath(4, 4, {(1, 1): {"lat": None}})
    null = {(r.scan, r.ray) for r in geometry.footprint_area(swath).where("pixel_area IS NULL").collect()}
    assert null == {(1, 1), (0, 1), (2, 1), (1, 0), (1, 2)}


def test_tile_borders_do_not_show(spark):
    n = geometry.TILE_SCANS * 2 + 5
    df = spark.range(n * 3).select(
        F.lit("GPM").alias("mission"), F.lit(1).alias("orbit"),
        (F.col("id") / 3).cast("int").alias("scan"), (F.col("id") % 3).cast("int").alias("ray"),
    ).withColumns({"lat": F.col("scan") * 0.04, "lon": F.col("ray") * 0.04})
    got = geometry.footprint_area(df).groupBy("scan").count()
    assert got.count() == n and got.where("count <> 3").count() == 0
    assert geometry.footprint_area(df).where("pixel_area IS NULL OR abs(pixel_area - 19.78) > 0.3").count() == 0


@pytest.mark.parametrize("scans", [1, 3, 7])
@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels_do_not_depend_on_the_tiles(spark, monkeypatch, scans, connectivity):
    monkeypatch.setattr(labels, "TILE_SCANS", scans)
    rng = random.Random(scans)
    rows, want = [], {}
    for mission, orbit in (("GPM", 7), ("TRMM", 7), ("GPM", 8)):
        cells = {(s, r) for s in range(5, 45) for r in range(20) if rng.random() < 0.5}
        want[mission, orbit] = flood(cells, connectivity)
        rows += [(mission, orbit, s, r, 30.0, 1.0) for s, r in cells]
    swath = spark.createDataFrame(rows, "mission string, orbit int, scan int, ray int, near_sfc_dbz float, pixel_area float")
    got = defaultdict(lambda: defaultdict(set))
    for r in labels.label_features(swath, connectivity=connectivity).collect():
        got[r.mission, r.orbit][r.local_label].add((r.scan, r.ray))
    assert {o: dict(v) for o, v in got.items()} == want


def test_least_reachable():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (10, 4), (200, 150), (500, 499)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v):
                want[a] = want[b] = min(want[a], want[b])
        assert np.array_equal(labels.least_reachable(n, u, v), want)
    chain = np.arange(4999)
    assert not labels.least_reachable(5000, chain, chain + 1).any()
