import pytest

from rainloom import constants as C
from rainloom.operators import echotops, features, labels

BIN = {h: 175 - int(h * 1000 / 125) for h in (5, 8, 10, 12, 13, 16, 17, 18)}
BIN_18_9 = 175 - 151  # 18,875 m


def run(swath):
    lab = labels.label_features(swath)
    members = features.join_members(swath, lab)
    rows = echotops.qc_echo_tops(members, swath).collect()
    assert len(rows) == 1
    return rows[0]


def blob(n_scan=7, rays=range(20, 26), scans=range(2, 5)):
    return {(s, r): {"near_sfc_dbz": 30.0, "storm_top": 9000.0} for s in scans for r in rays}


def test_clean_tower(make_swath):
    px = blob()
    px[(3, 22)]["bins"] = {BIN[10]: 25.0}
    row = run(make_swath(7, 49, px))
    assert (row.max_ht_20dbz, row.max_ht_20dbz_scan, row.max_ht_20dbz_ray) == (10000.0, 3, 22)
    assert row.echotop_qc_flags == 0 and not row.max_ht_20dbz_censored and row.max_ht_30dbz is None
    assert row.max_ht_30dbz_scan == -1 and row.ray_obs_ceiling_m == 19000.0


def test_mirror_echo_removed(make_swath):
    px = blob()
    px[(3, 22)].update(bins={BIN[10]: 25.0, BIN[18]: 25.0}, bin_mirror_image=BIN[16])
    row = run(make_swath(7, 49, px))
    assert row.max_ht_20dbz == 10000.0 and row.echotop_qc_flags == C.FLAG_MIRROR


def test_outer_ray_clutter_removed(make_swath):
    px = blob(rays=range(4, 10))
    px[(3, 6)]["bins"] = {BIN[18]: 25.0, BIN[8]: 25.0}
    row = run(make_swath(7, 49, px))
    assert row.max_ht_20dbz == 8000.0 and row.echotop_qc_flags == C.FLAG_SIDELOBE


def test_outer_ray_low_top_kept(make_swath):
    px = blob(rays=range(42, 47))
    px[(3, 44)]["bins"] = {BIN[13]: 25.0}
    assert run(make_swath(7, 49, px)).max_ht_20dbz == 13000.0


def test_isolated_spike_peeled(make_swath):
    px = blob()
    px[(3, 22)]["bins"] = {BIN[17]: 32.0}
    px[(2, 24)]["bins"] = {BIN[12]: 32.0}
    row = run(make_swath(7, 49, px))
    # the peeled bins are gone for the higher thresholds too
    assert row.max_ht_20dbz == row.max_ht_30dbz == 12000.0
    assert row.echotop_qc_flags == C.FLAG_PEELED


def test_real_overshoot_kept(make_swath):
    px = blob()
    for p in px.values():
        p["storm_top"] = 17000.0
    px[(3, 22)].update(bins={BIN_18_9: 25.0}, rates={BIN_18_9: 9.0, BIN[16]: 3.0})
    row = run(make_swath(7, 49, px))
    assert row.max_ht_20dbz == 18875.0 and row.max_ht_20dbz_censored
    assert row.echotop_qc_flags == C.FLAG_TRUNCATED | C.FLAG_CENSORED | C.FLAG_DD_FROM_TOP | C.FLAG_OVERSHOOT


def test_gives_up_after_four_peels(make_swath):
    px = blob()
    for i, r in enumerate(range(20, 25)):
        px[(3, r)]["bins"] = {BIN[17] + i: 25.0}
    px[(2, 24)]["bins"] = {BIN[10]: 45.0}
    row = run(make_swath(7, 49, px))
    assert row.max_ht_20dbz is None and row.max_ht_40dbz is None and row.ray_obs_ceiling_m is None
    assert row.echotop_qc_flags == C.FLAG_PEELED


def test_missing_neighbours_are_not_isolation(make_swath):
    px = blob()
    for p in px.values():
        p["storm_top"] = None
    px[(3, 22)]["bins"] = {BIN[17]: 25.0}
    assert run(make_swath(7, 49, px)).max_ht_20dbz == 17000.0


def test_raw_top_first_pixel_wins_ties(make_swath):
    px = blob()
    px[(3, 24)]["bins"] = {BIN[8]: 45.0}
    px[(3, 22)]["bins"] = {BIN[8]: 45.0}
    swath = make_swath(7, 49, px)
    members = features.join_members(swath, labels.label_features(swath), echo=False)
    row = echotops.raw_echo_tops(members, (40, 50)).first()
    assert (row.raw_ht_40dbz, row.raw_ht_40dbz_scan, row.raw_ht_40dbz_ray) == (8000.0, 3, 22)
    assert (row.raw_ht_50dbz, row.raw_ht_50dbz_scan, row.raw_ht_50dbz_ray) == (None, -1, -1)


def test_pixel_tops_use_geometric_gates_only(make_swath):
    px = blob()
    px[(3, 22)]["bins"] = {BIN[17]: 25.0}
    px[(3, 4)] = {"bins": {BIN[17]: 25.0, BIN[5]: 41.0}}
    got = {(r.scan, r.ray): (r.top_20, r.top_40) for r in echotops.pixel_echo_tops(make_swath(7, 49, px)).collect()}
    assert got[(3, 22)] == (17000.0, None)
    assert got[(3, 4)] == (5000.0, 5000.0)


@pytest.mark.parametrize("height,expect", [(15000.0, True), (15001.0, False)])
def test_isolation_threshold(make_swath, height, expect):
    swath = make_swath(3, 3, {(0, 0): {"storm_top": height}})
    got = {(r.scan, r.ray): r.isolated for r in echotops.isolated(swath, swath).collect()}
    assert got[(1, 1)] is expect
    assert (2, 2) not in got
