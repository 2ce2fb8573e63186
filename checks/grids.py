"""Gridding, joins over grids, climatology and grid analyses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import CTES, RT, echo_case, latbin, lonbin, register, size_case
from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.operators import gridding, sets
from rainloom.plans import climatology as cl
from rainloom.plans import grid_views as gv

# Swath grids use half-degree cells, catalogue grids five-degree cells, so that cells hold many samples.
DEG, BIG = 0.5, 5.0
FK = "mission, orbit, local_label"
CH = "lat_bin, lon_bin, hour"
CLS = "size_class, echotop_class, raintype"

CTES["seen"] = f"""
SELECT mission, orbit, scan, ray, e, rain_type, near_sfc_rain, epsilon, nw, dm, time, year(time) AS year, month(time) AS month, hour(time) AS hour,
       {latbin('lat', DEG)} AS lat_bin, {lonbin('lon', DEG)} AS lon_bin FROM px WHERE near_sfc_rain IS NOT NULL"""
CTES["fcls"] = f"""
SELECT q.mission, q.orbit, q.local_label, {size_case('CAST(CAST(CASE WHEN x.n < 2 THEN 0 ELSE x.major END AS FLOAT) AS DOUBLE)')} AS size_class,
       {echo_case('max_ht_20dbz')} AS echotop_class FROM qc_out q JOIN axes x USING ({FK})"""
CTES["pcls"] = f"SELECT l.mission, l.orbit, l.scan, l.ray, size_class, echotop_class FROM lab l JOIN fcls USING ({FK})"
CTES["swath_rain"] = f"""
SELECT mission, year, month, {CH}, coalesce(size_class, 4) AS size_class, coalesce(echotop_class, 4) AS echotop_class, rain_type - 1 AS raintype,
       sum(near_sfc_rain) AS rain_sum, count(*) AS raining_count
FROM seen LEFT JOIN pcls USING (mission, orbit, scan, ray) WHERE near_sfc_rain > 0 AND rain_type IN (1, 2, 3) GROUP BY ALL"""
CTES["swath_views"] = f"SELECT mission, year, month, {CH}, count(*) AS n_views FROM seen GROUP BY ALL"
CTES["ptop"] = """
SELECT mission, orbit, scan, ray, max(h) FILTER (WHERE z >= 20) AS top20, max(h) FILTER (WHERE z >= 30) AS top30, max(h) FILTER (WHERE z >= 40) AS top40
FROM bins WHERE NOT (h > 15000 AND (is_outer OR h > mirror_h)) AND rain_type = 2 GROUP BY 1, 2, 3, 4"""
_M = [f"coalesce(sum(top{t}), 0) AS et{t}_sum, count(top{t}) AS et{t}_n" for t in (20, 30, 40)]
_M += [f"count(*) FILTER (WHERE near_sfc_rain >= {t}) AS cnt_gt{t}" for t in (25, 50, 75, 100)]
for _n, _c in (("eps", "epsilon"), ("nw", "nw"), ("dm", "dm")):
    for _k, _t in (("conv", 2), ("strat", 1)):
        _M.append(
            f"coalesce(sum({_c}) FILTER (WHERE rain_type = {_t}), 0) AS {_n}_{_k}_sum, count({_c}) FILTER (WHERE rain_type = {_t}) AS {_n}_{_k}_n"
        )
_COUNTS = [c for c in C.METRIC_COLS if not c.endswith("_sum")]
_SUMS = [c for c in C.METRIC_COLS if c.endswith("_sum")]
CTES["swath_metrics"] = f"""
SELECT * FROM (SELECT mission, year, month, {CH}, {', '.join(_M)} FROM seen LEFT JOIN ptop USING (mission, orbit, scan, ray) GROUP BY mission, year, month, {CH}) AS m
WHERE {' OR '.join(f'{c} > 0' for c in _COUNTS)}"""
CTES["obs"] = f"""
SELECT p.*, f.major_axis_km, f.max_ht_20dbz, {size_case('f.major_axis_km')} AS size_class, {echo_case('f.max_ht_20dbz')} AS echotop_class, {RT} AS raintype,
       month(p.time) AS month, hour(p.time) AS hour, {latbin('p.lat', BIG)} AS lat_bin, {lonbin('p.lon', BIG)} AS lon_bin
FROM pix p JOIN (SELECT feature_id, major_axis_km, max_ht_20dbz FROM cat) f USING (feature_id)"""
CTES["obs_rain"] = f"""
SELECT mission, month, {CH}, {CLS}, sum(near_sfc_rain) AS rain_sum, count(*) AS raining_count FROM obs WHERE near_sfc_rain > 0 AND raintype IS NOT NULL GROUP BY ALL"""
CTES["obs_views"] = f"SELECT mission, month, {CH}, count(*) AS n_views FROM obs WHERE near_sfc_rain IS NOT NULL GROUP BY ALL"
CTES["obs_size"] = f"""
SELECT mission, month, {CH}, size_class AS class, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM obs_rain GROUP BY ALL"""

CTES["size_classes"] = "SELECT unnest(range(5)) AS class"


def month_grids(t):
    return gridding.grid_months(t.profiles, t.labels, t.swath_features, deg=DEG)


def staged_grids(t):
    """The three month tables of the swath, written once."""
    from rainloom.session import materialize

    if not hasattr(t, "_grids"):
        t._grids = {k: materialize(v, f"grid-{k}") for k, v in month_grids(t).items()}
    return t._grids


def month_job(t):
    """Stored rain of the month job, and its report of months."""
    from rainloom.plans import jobs
    from rainloom.session import shared_folder
    from rainloom.sources import lake

    if not hasattr(t, "_month_job"):
        root = f"{shared_folder(t.spark)}/rainloom/months-{uuid.uuid4().hex}"
        jobs.run_grids(t.profiles, t.labels, t.swath_features, root, deg=DEG)
        t._month_job = (lake.read_table(t.spark, root, "grid_rain", granule=False), t.spark.read.parquet(f"{root}/processed_months"))
    return t._month_job


def obs(t):
    return gridding.join_pixels_features(t.pixels, t.features).withColumns(
        {
            "month": F.month("time"),
            "hour": F.hour("time"),
            "lat_bin": S.lat_bin("lat", BIG),
            "lon_bin": S.lon_bin("lon", BIG),
            "size_class": S.size_class("major_axis_km"),
            "echotop_class": S.echotop_class("max_ht_20dbz"),
            "raintype": S.raintype_class("rain_type"),
        }
    )


def obs_grids(t):
    """Rain (joint and by size) and views of the catalogue pixels, written once."""
    from rainloom.session import materialize

    if not hasattr(t, "_obs_grids"):
        keys = ["mission", "month", "lat_bin", "lon_bin", "hour"]
        o = obs(t)
        wet = o.where("near_sfc_rain > 0 AND raintype IS NOT NULL")
        joint = wet.groupBy(*keys, *gridding.RAIN_CLASSES).agg(F.sum("near_sfc_rain").alias("rain_sum"), F.count("*").alias("raining_count"))
        views = o.where(S.is_view()).groupBy(*keys).agg(F.count("*").alias("n_views"))
        joint, views = materialize(joint, "obs-rain"), materialize(views, "obs-views")
        t._obs_grids = joint, views
    return t._obs_grids


def by_size(t):
    joint, views = obs_grids(t)
    return gridding.marginals(joint).where("breakdown = 'size'"), views


_MK = "year month"
_CK = "lat_bin lon_bin hour"

register(
    "G1_orbit_views",
    lambda t: gridding.orbit_views(t.flat, 0.05),
    f"""SELECT {latbin('lat', 0.05)} AS lat_bin, {lonbin('lon', 0.05)} AS lon_bin, count(*) AS n_views, mission, orbit, any_value(time0) AS time
        FROM px JOIN (SELECT orbit AS o, sum(CAST(epoch_us(t) AS HUGEINT)) // count(*) AS time0 FROM (SELECT orbit, scan, max(time) AS t FROM px GROUP BY 1, 2) AS s GROUP BY 1) m ON m.o = orbit
        WHERE near_sfc_rain IS NOT NULL GROUP BY 1, 2, 4, 5""",
    longs="lat_bin lon_bin n_views orbit time",
)
register(
    "G2_hour_views",
    lambda t: gridding.hour_views(t.flat, ("2024-01-01", "2024-01-15"), DEG),
    f"SELECT mission, {CH}, count(*) AS n_views FROM seen WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-01-15' GROUP BY ALL",
    longs=f"{_CK} n_views",
)
register(
    "G3_class_maps",
    lambda t: gridding.class_maps(t.labels, t.swath_features),
    "SELECT * FROM pcls",
    longs="orbit scan ray size_class echotop_class",
)
_RAINL = f"{_CK} size_class echotop_class raintype raining_count"
register(
    "G4_hour_rain",
    lambda t: gridding.hour_rain(t.flat, t.labels, t.swath_features, deg=DEG),
    f"SELECT mission, {CH}, {CLS}, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM swath_rain GROUP BY ALL",
    doubles="rain_sum",
    longs=_RAINL,
)
register(
    "G5_hour_metrics",
    lambda t: gridding.hour_metrics(t.swath, deg=DEG),
    f"SELECT mission, {CH}, {', '.join(f'sum({c}) AS {c}' for c in C.METRIC_COLS)} FROM swath_metrics GROUP BY ALL",
    doubles=" ".join(_SUMS),
    longs=f"{_CK} {' '.join(_COUNTS)}",
    digits=2,
)
register(
    "G7_merge_partials",
    lambda t: gridding.merge_partials(
        [staged_grids(t)["rain"].where(F.col("hour") % 3 == i) for i in range(3)],
        ["mission", "lat_bin", "lon_bin", "raintype"], ["rain_sum", "raining_count"],
    ),
    "SELECT mission, lat_bin, lon_bin, raintype, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM swath_rain GROUP BY ALL",
    doubles="rain_sum",
    longs="lat_bin lon_bin raintype raining_count",
)
register(
    "G8_month_rain",
    lambda t: month_grids(t)["rain"],
    "SELECT * FROM swath_rain",
    doubles="rain_sum",
    longs=f"{_MK} {_RAINL}",
)
register("G8_month_views", lambda t: month_grids(t)["views"], "SELECT * FROM swath_views", longs=f"{_MK} {_CK} n_views")
register(
    "G9_metrics_only",
    lambda t: gridding.grid_months(t.swath, None, None, metrics_only=True, deg=DEG)["metrics"],
    "SELECT * FROM swath_metrics",
    doubles=" ".join(_SUMS),
    longs=f"{_MK} {_CK} {' '.join(_COUNTS)}",
    digits=2,
)
register(
    "G10_J1_month_joint",
    lambda t: gridding.accumulate_month(t.pixels.withColumn("month", F.month("time")), t.features, 7, BIG, ("mission",)),
    f"""SELECT mission, lat_bin, lon_bin, {CLS}, sum(near_sfc_rain) AS rain_sum, count(*) AS raining_count FROM obs
        WHERE month = 7 AND near_sfc_rain > 0 AND raintype IS NOT NULL GROUP BY ALL""",
    doubles="rain_sum",
    longs="lat_bin lon_bin size_class echotop_class raintype raining_count",
)
register(
    "J1_pixels_features",
    lambda t: gridding.join_pixels_features(t.pixels, t.features).select("feature_id", "scan", "ray", "major_axis_km", "max_ht_20dbz"),
    "SELECT feature_id, scan, ray, major_axis_km, max_ht_20dbz FROM obs",
    doubles="major_axis_km max_ht_20dbz",
    longs="feature_id scan ray",
)
register(
    "G11_views_reduce",
    lambda t: gridding.reduce_views(obs_grids(t)[1], 3, ("mission",)),
    "SELECT mission, lat_bin, lon_bin, sum(n_views) AS n_views FROM obs_views WHERE month = 3 GROUP BY ALL",
    longs="lat_bin lon_bin n_views",
)
register(
    "G12_rain_reduce",
    lambda t: gridding.reduce_rain_hour(staged_grids(t)["rain"], deg=DEG),
    f"SELECT mission, month, {CH}, {CLS}, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM swath_rain GROUP BY ALL",
    doubles="rain_sum",
    longs=f"month {_RAINL}",
)
register(
    "G13_views_hour_reduce",
    lambda t: gridding.reduce_views_hour(staged_grids(t)["views"], deg=DEG),
    f"SELECT mission, month, {CH}, sum(n_views) AS n_views FROM swath_views GROUP BY ALL",
    longs=f"month {_CK} n_views",
)
register(
    "G14_metrics_reduce",
    lambda t: gridding.reduce_metrics_hour(staged_grids(t)["metrics"], deg=DEG),
    f"SELECT mission, month, {CH}, {', '.join(f'sum({c}) AS {c}' for c in C.METRIC_COLS)} FROM swath_metrics GROUP BY ALL",
    doubles=" ".join(_SUMS),
    longs=f"month {_CK} {' '.join(_COUNTS)}",
    digits=2,
)
CTES["obs_marg"] = f"""
SELECT mission, month, {CH}, breakdown, class, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM (
  SELECT *, 'size' AS breakdown, size_class AS class FROM obs_rain UNION ALL SELECT *, 'echotop', echotop_class FROM obs_rain
  UNION ALL SELECT *, 'raintype', raintype FROM obs_rain) AS u GROUP BY ALL"""
register(
    "G15_marginals",
    lambda t: gridding.marginals(obs_grids(t)[0]),
    "SELECT * FROM obs_marg",
    doubles="rain_sum",
    longs=f"month {_CK} class raining_count",
)


def _label_case(col, names):
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


register(
    "G16_crossproduct",
    lambda t: gridding.crossproduct(obs_grids(t)[0], band=(-12.0, 12.0), deg=BIG).drop("hour").groupBy(
        "lat_bin", "lon_bin", "size_label", "echotop_label", "raintype_label").agg(F.sum("rain_sum").alias("rain_sum")),
    f"""SELECT lat_bin, lon_bin, {_label_case('size_class', C.SIZE_LABELS)} AS size_label, {_label_case('echotop_class', C.ECHOTOP_LABELS)} AS echotop_label,
        {_label_case('raintype', C.RAINTYPE_LABELS)} AS raintype_label, sum(rain_sum) AS rain_sum FROM obs_rain WHERE lat_bin BETWEEN 15 AND 20 GROUP BY ALL""",
    doubles="rain_sum",
    longs="lat_bin lon_bin",
)
register(
    "G17_densify",
    lambda t: gridding.densify(
        gridding.reduce_views(obs_grids(t)[1], by=("month",)), ["n_views"], {"month": range(1, 13)}, (-38.0, 38.0), (-90.0, 90.0), BIG),
    f"""SELECT month, lat_bin, lon_bin, -90.0 + (lat_bin + 0.5) * 5.0 AS lat, -180.0 + (lon_bin + 0.5) * 5.0 AS lon, coalesce(n, 0) AS n_views
        FROM (SELECT month, lat_bin, lon_bin FROM (SELECT unnest(range(1, 13)) AS month) AS m, (SELECT unnest(range(10, 26)) AS lat_bin) AS a, (SELECT unnest(range(18, 54)) AS lon_bin) AS b) AS d
        LEFT JOIN (SELECT month, lat_bin, lon_bin, sum(n_views) AS n FROM obs_views GROUP BY ALL) v USING (month, lat_bin, lon_bin)""",
    doubles="lat lon",
    longs="month lat_bin lon_bin n_views",
)
register(
    "G18_climatology_joint",
    lambda t: gridding.climatology(staged_grids(t)["rain"], staged_grids(t)["views"], staged_grids(t)["metrics"], deg=DEG)["joint"].select("mission", "month", "lat_bin", "lon_bin", "hour", "size_class", "echotop_class", "raintype", "rain_sum", "raining_count"),
    f"""SELECT mission, month, {CH}, {CLS}, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM swath_rain
        WHERE lat_bin BETWEEN 44 AND 316 GROUP BY mission, month, {CH}, {CLS}""",
    doubles="rain_sum",
    longs="month lat_bin lon_bin hour size_class echotop_class raintype raining_count",
)
register(
    "G18_climatology_views",
    lambda t: gridding.climatology(staged_grids(t)["rain"], staged_grids(t)["views"], staged_grids(t)["metrics"], deg=DEG)["views"].select("mission", "month", "lat_bin", "lon_bin", "hour", "n_views"),
    f"SELECT mission, month, {CH}, sum(n_views) AS n_views FROM swath_views WHERE lat_bin BETWEEN 44 AND 316 GROUP BY mission, month, {CH}",
    longs="month lat_bin lon_bin hour n_views",
)
register(
    "G18_month_job",
    lambda t: month_job(t)[0],
    f"SELECT mission, year, month, {CH}, {CLS}, rain_sum, raining_count FROM swath_rain",
    doubles="rain_sum",
    longs="year month lat_bin lon_bin hour size_class echotop_class raintype raining_count",
)
register(
    "IO7_processed_months",
    lambda t: month_job(t)[1],
    """SELECT * FROM (SELECT mission, year(time) AS year, month(time) AS month FROM px GROUP BY ALL) AS m
       LEFT JOIN (SELECT mission, year, month, count(*) AS n_views FROM swath_views GROUP BY ALL) AS v USING (mission, year, month)
       LEFT JOIN (SELECT mission, year, month, count(*) AS n_rain FROM swath_rain GROUP BY ALL) AS r USING (mission, year, month)
       LEFT JOIN (SELECT mission, year, month, count(*) AS n_metrics FROM swath_metrics GROUP BY ALL) AS k USING (mission, year, month)""",
    longs="year month n_views n_rain n_metrics",
)
register(
    "G18_climatology",
    lambda t: gridding.climatology(staged_grids(t)["rain"], staged_grids(t)["views"], staged_grids(t)["metrics"], deg=DEG)["rain"],
    f"""SELECT mission, month, {CH}, breakdown, class, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining_count FROM (
        SELECT *, 'size' AS breakdown, size_class AS class FROM swath_rain UNION ALL SELECT *, 'echotop', echotop_class FROM swath_rain
        UNION ALL SELECT *, 'raintype', raintype FROM swath_rain) AS u WHERE lat_bin BETWEEN 44 AND 316 GROUP BY mission, month, {CH}, breakdown, class""",
    doubles="rain_sum",
    longs=f"month {_CK} class raining_count",
)

# --- numerator over denominator, lookups ----------------------------------

register(
    "J3_rain_over_views",
    lambda t: gridding.combine(
        obs_grids(t)[0].groupBy("mission", "lat_bin", "lon_bin", "hour").agg(F.sum("rain_sum").alias("rain_sum"), F.sum("raining_count").alias("raining_count")),
        obs_grids(t)[1].groupBy("mission", "lat_bin", "lon_bin", "hour").agg(F.sum("n_views").alias("n_views")),
        ["mission", "lat_bin", "lon_bin", "hour"],
    ),
    f"""SELECT v.*, coalesce(r, 0) AS rain_sum, coalesce(c, 0) AS raining_count FROM (SELECT mission, {CH}, sum(n_views) AS n_views FROM obs_views GROUP BY ALL) v
        LEFT JOIN (SELECT mission, {CH}, sum(rain_sum) AS r, sum(raining_count) AS c FROM obs_rain GROUP BY ALL) x USING (mission, {CH})""",
    doubles="rain_sum",
    longs=f"{_CK} n_views raining_count",
)
register(
    "J12_R8_mission_difference",
    lambda t: gv.mission_difference(*obs_grids(t), deg=BIG),
    """SELECT a.lat_bin, a.lon_bin, a.rate AS rate_a, b.rate AS rate_b, a.rate - b.rate AS difference FROM cellrate a JOIN cellrate b
       ON a.lat_bin = b.lat_bin AND a.lon_bin = b.lon_bin WHERE a.mission = 'GPM' AND b.mission = 'TRMM' AND a.v >= 5 AND b.v >= 5 AND a.lat_bin BETWEEN 10 AND 25""",
    doubles="rate_a rate_b difference",
    longs="lat_bin lon_bin",
    digits=10,
)
CTES["cellrate"] = """
SELECT mission, lat_bin, lon_bin, v, coalesce(r, 0) / v AS rate FROM (SELECT mission, lat_bin, lon_bin, sum(n_views) AS v FROM obs_views GROUP BY ALL) AS n
LEFT JOIN (SELECT mission, lat_bin, lon_bin, sum(rain_sum) AS r FROM obs_rain GROUP BY ALL) w USING (mission, lat_bin, lon_bin)"""
register(
    "J13_value_at_points",
    lambda t: gridding.value_at(
        gridding.reduce_views(obs_grids(t)[1]),
        t.features.select("feature_id", (F.col("centroid_lat") * 2).alias("lat"), (F.col("centroid_lon") + 200).alias("lon")),
        ["n_views"], band=(-68.0, 68.0), deg=BIG,
    ).select("feature_id", F.col("n_views").cast("double").alias("n_views")),
    f"""SELECT feature_id, n_views FROM (SELECT feature_id, CASE WHEN lat BETWEEN -72.5 AND 72.5 THEN greatest(4, least(31, {latbin('lat', BIG)})) END AS lat_bin, {lonbin('lon', BIG)} AS lon_bin
        FROM (SELECT feature_id, centroid_lat * 2 AS lat, centroid_lon + 200 AS lon FROM cat) AS c) AS k
        LEFT JOIN (SELECT lat_bin, lon_bin, sum(n_views) AS n_views FROM obs_views GROUP BY ALL) v USING (lat_bin, lon_bin)""",
    doubles="n_views",
    longs="feature_id",
)

# --- sets -----------------------------------------------------------------

register(
    "U1_U3_union_by_name",
    lambda t: sets.union_by_name([
        t.features.where("mission = 'GPM'").select("feature_id", "mission", "area_km2"),
        t.features.where("mission = 'TRMM'").select("area_km2", "feature_id"),
    ]),
    "SELECT feature_id, CASE WHEN mission = 'GPM' THEN mission END AS mission, area_km2 FROM cat",
    doubles="area_km2",
    longs="feature_id",
)
_POOL = ["rain_sum", "raining", "n_views"]


def obs_totals(t):
    return cl.annual_totals(*obs_grids(t))


CTES["obs_totals"] = f"""
SELECT mission, lat_bin, lon_bin, {', '.join(f'coalesce({c}, 0) AS {c}' for c in cl.TOTALS)}
FROM (SELECT mission, lat_bin, lon_bin, sum(n_views) AS n_views FROM obs_views GROUP BY ALL) v
FULL JOIN (SELECT mission, lat_bin, lon_bin, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining,
  sum(rain_sum) FILTER (WHERE raintype = 1) AS conv_rain_sum, sum(raining_count) FILTER (WHERE raintype = 1) AS conv_raining,
  sum(rain_sum) FILTER (WHERE raintype = 0) AS strat_rain_sum, sum(raining_count) FILTER (WHERE raintype = 0) AS strat_raining
  FROM obs_rain GROUP BY mission, lat_bin, lon_bin) r USING (mission, lat_bin, lon_bin)"""
CTES["obs_pool"] = f"""
SELECT member, lat_bin, lon_bin, {', '.join(f'sum({c}) AS {c}' for c in cl.TOTALS)} FROM (
  SELECT *, mission AS member FROM obs_totals UNION ALL SELECT *, 'COMBINED' FROM obs_totals) AS u GROUP BY ALL"""
_TD = "rain_sum conv_rain_sum strat_rain_sum"
_TL = "lat_bin lon_bin raining conv_raining strat_raining n_views"
register(
    "U2_combined_member",
    lambda t: cl.pooled_members(obs_totals(t), deg=BIG),
    "SELECT * FROM obs_pool",
    doubles=_TD,
    longs=_TL,
)
register(
    "U4_missing_months",
    # every month of the record, with its rows and those that count as present
    lambda t: sets.month_coverage(
        t.features.select("mission", F.year("time").alias("year"), F.month("time").alias("month")), (F.col("month") % 4 != 1) | (F.col("year") == 1997)
    ),
    """SELECT f.mission, year(f.d) AS year, month(f.d) AS month, coalesce(n, 0) AS n, coalesce(n_present, 0) AS n_present, coalesce(n_present, 0) = 0 AS missing
       FROM (SELECT mission, unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS d FROM inv GROUP BY mission) AS f LEFT JOIN inv i ON i.mission = f.mission AND i.d = f.d""",
    longs="year month n n_present",
)
CTES["inv"] = """
SELECT mission, date_trunc('month', time) AS d, count(*) AS n, count(*) FILTER (WHERE month(time) % 4 <> 1 OR year(time) = 1997) AS n_present FROM cat GROUP BY 1, 2"""
register("U5_distinct_missions", lambda t: sets.distinct_values(t.features, "mission"), "SELECT DISTINCT mission FROM cat")
register(
    "U6_same_rows",
    lambda t: sets.same_rows(
        t.pixels.select("feature_id", "scan", "ray"), t.pixels.where("ray <> 7").select("ray", "feature_id", "scan").repartition(5)
    ),
    "SELECT feature_id, scan, ray, 'left' AS side FROM pix WHERE ray = 7",
    longs="feature_id scan ray",
)
register(
    "U6_shared_ids",
    lambda t: sets.shared_ids(t.pixels.withColumn("feature_id", F.col("scan"))).withColumnRenamed("feature_id", "id"),
    "SELECT scan AS id, count(DISTINCT mission) AS n_groups FROM pix GROUP BY 1 HAVING count(DISTINCT mission) > 1",
    longs="id n_groups",
)

# --- annual quantities ----------------------------------------------------

CTES["sw_totals"] = f"""
SELECT mission, lat_bin, lon_bin, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*cl.TOTALS, *C.METRIC_COLS))}
FROM (SELECT mission, lat_bin, lon_bin, sum(n_views) AS n_views FROM swath_views GROUP BY ALL) v
FULL JOIN (SELECT mission, lat_bin, lon_bin, sum(rain_sum) AS rain_sum, sum(raining_count) AS raining,
  sum(rain_sum) FILTER (WHERE raintype = 1) AS conv_rain_sum, sum(raining_count) FILTER (WHERE raintype = 1) AS conv_raining,
  sum(rain_sum) FILTER (WHERE raintype = 0) AS strat_rain_sum, sum(raining_count) FILTER (WHERE raintype = 0) AS strat_raining
  FROM swath_rain GROUP BY mission, lat_bin, lon_bin) r USING (mission, lat_bin, lon_bin)
FULL JOIN (SELECT mission, lat_bin, lon_bin, {', '.join(f'sum({c}) AS {c}' for c in C.METRIC_COLS)} FROM swath_metrics GROUP BY mission, lat_bin, lon_bin) m
  USING (mission, lat_bin, lon_bin)"""
CTES["sw_pool"] = f"""
SELECT member, lat_bin, lon_bin, {', '.join(f'sum({c}) AS {c}' for c in (*cl.TOTALS, *C.METRIC_COLS))} FROM (
  SELECT *, mission AS member FROM sw_totals UNION ALL SELECT *, 'COMBINED' FROM sw_totals) AS u GROUP BY ALL"""


def _q(num, den, cond):
    return f"CASE WHEN {cond} THEN CAST({num} AS DOUBLE) / nullif({den}, 0) END"


_SEEN = "n_views >= 10"
_QSQL = {
    "rain": _q("rain_sum", "n_views", _SEEN) + " * 8766.0",
    "raining_views": f"CASE WHEN {_SEEN} THEN raining END",
    "views": "n_views",
    "rate": _q("rain_sum", "n_views", _SEEN),
    "freq": _q("raining", "n_views", _SEEN),
    "intensity": _q("rain_sum", "raining", "raining >= 1"),
    "conv_rain": _q("conv_rain_sum", "n_views", _SEEN) + " * 8766.0",
    "strat_rain": _q("strat_rain_sum", "n_views", _SEEN) + " * 8766.0",
    "conv_freq": _q("conv_raining", "n_views", _SEEN),
    "strat_freq": _q("strat_raining", "n_views", _SEEN),
    "conv_intensity": _q("conv_rain_sum", "conv_raining", "conv_raining >= 1"),
    "strat_intensity": _q("strat_rain_sum", "strat_raining", "strat_raining >= 1"),
    "conv_rain_frac": _q("conv_rain_sum", "rain_sum", f"{_SEEN} AND rain_sum > 0"),
    "conv_pixel_frac": _q("conv_raining", "raining", "raining >= 1"),
    **{f"echotop{t}": _q(f"et{t}_sum", f"et{t}_n", f"et{t}_n >= 10") for t in (20, 30, 40)},
    **{f"freq_gt{t}": _q(f"cnt_gt{t}", "n_views", _SEEN) for t in (25, 50, 75, 100)},
    **{f"{n}_{k}": _q(f"{n}_{k}_sum", f"{n}_{k}_n", f"{n}_{k}_n >= 10") + (" / 10.0" if n == "nw" else "") for n in ("eps", "nw", "dm") for k in ("conv", "strat")},
}
CTES["sw_fields"] = f"SELECT member, lat_bin, lon_bin, {', '.join(f'{_QSQL[q]} AS {q}' for q in cl.QUANTITIES)} FROM sw_pool"
CTES["sw_long"] = f"""
SELECT * FROM (SELECT member, lat_bin, lon_bin, unnest([{', '.join(f"'{q}'" for q in cl.QUANTITIES)}]) AS quantity,
  unnest([{', '.join(f'CAST({q} AS DOUBLE)' for q in cl.QUANTITIES)}]) AS value FROM sw_fields) AS l WHERE value IS NOT NULL"""


def fields(t):
    from rainloom.session import materialize

    if not hasattr(t, "_fields"):
        g = staged_grids(t)
        t._fields = materialize(cl.annual_fields(g["rain"], g["views"], g["metrics"], deg=DEG), "fields")
    return t._fields


register(
    "Q1_annual_totals",
    lambda t: cl.annual_totals(*[staged_grids(t)[k] for k in ("rain", "views", "metrics")]),
    "SELECT * FROM sw_totals",
    doubles=_TD + " " + " ".join(_SUMS),
    longs=_TL + " " + " ".join(_COUNTS),
    digits=2,
)
_QGROUP = {
    "Q2_annual_rain": ("rain", "conv_rain", "strat_rain"),
    "Q3_rate_and_frequency": ("rate", "freq", "conv_freq", "strat_freq"),
    "Q4_intensity": ("intensity", "conv_intensity", "strat_intensity"),
    "Q5_Q6_convective_fractions": ("conv_rain_frac", "conv_pixel_frac"),
    "Q7_sampling": ("views", "raining_views"),
    "Q8_tops_and_drop_size": ("echotop20", "echotop30", "echotop40", "eps_conv", "eps_strat", "dm_conv", "dm_strat"),
    "Q9_drop_concentration": ("nw_conv", "nw_strat"),
    "Q10_heavy_rain_frequency": ("freq_gt25", "freq_gt50", "freq_gt75", "freq_gt100"),
}
for _name, _cols in _QGROUP.items():
    register(
        _name,
        lambda t, cols=_cols: cl.annual_fields(*[staged_grids(t)[k] for k in ("rain", "views", "metrics")], deg=DEG).select(
            "member", "lat_bin", "lon_bin", *[F.col(c).cast("double").alias(c) for c in cols]
        ),
        f"SELECT member, lat_bin, lon_bin, {', '.join(_cols)} FROM sw_fields",
        doubles=" ".join(_cols),
        longs="lat_bin lon_bin",
        digits=6 if _name.startswith(("Q2", "Q8")) else 8,
    )
_WIDE = [(m, q) for m in cl.MEMBERS for q in cl.QUANTITIES]
register(
    "Q11_wide_fields",
    lambda t: cl.pivot_members(fields(t)).select("lat_bin", "lon_bin", *[F.col(f"{m}_{q}").cast("double").alias(f"{m}_{q}") for m, q in _WIDE]),
    "SELECT lat_bin, lon_bin, " + ", ".join(f"max({q}) FILTER (WHERE member = '{m}') AS {m}_{q}" for m, q in _WIDE) + " FROM sw_fields GROUP BY 1, 2",
    doubles=" ".join(f"{m}_{q}" for m, q in _WIDE),
    longs="lat_bin lon_bin",
    digits=3,
)
register(
    "Q12_display_ranges",
    lambda t: cl.display_ranges(fields(t)),
    """SELECT member, quantity, CASE WHEN g = 'nw' THEN 2.5 WHEN g99 IS NOT NULL THEN g01 ELSE lo END AS vmin,
       CASE WHEN g = 'nw' THEN 4.5 WHEN g99 IS NOT NULL THEN g99 ELSE hi END AS vmax, CASE WHEN g = 'nw' THEN 2.0 ELSE 0.0 END AS dlo,
       CASE WHEN g = 'nw' THEN 5.0 WHEN g99 IS NOT NULL THEN g99 * CAST(1.05 AS DOUBLE) ELSE greatest(q9999, hi * CAST(1.05 AS DOUBLE)) END AS dhi
       FROM (SELECT *, CASE WHEN q999 > q001 THEN q001 ELSE 0 END AS lo, CASE WHEN q999 > q001 OR q999 > 0 THEN q999 ELSE 1 END AS hi,
             CASE WHEN quantity LIKE 'nw%' THEN 'nw' WHEN quantity LIKE 'dm%' THEN 'dm' WHEN quantity LIKE 'eps%' THEN 'eps' WHEN quantity LIKE 'echotop%' THEN 'echotop' END AS g
             FROM (SELECT member, quantity, quantile_cont(value, 0.001) AS q001, quantile_cont(value, 0.999) AS q999, quantile_cont(value, 0.9999) AS q9999 FROM sw_long GROUP BY 1, 2) AS a) AS b
       LEFT JOIN (SELECT CASE WHEN quantity LIKE 'dm%' THEN 'dm' WHEN quantity LIKE 'eps%' THEN 'eps' ELSE 'echotop' END AS g, quantile_cont(value, 0.01) AS g01, quantile_cont(value, 0.99) AS g99
                  FROM sw_long WHERE quantity LIKE 'dm%' OR quantity LIKE 'eps%' OR quantity LIKE 'echotop%' GROUP BY 1) p USING (g)""",
    doubles="vmin vmax dlo dhi",
    digits=4,
)
register(
    "Q13_valid_max",
    lambda t: cl.valid_max(fields(t)),
    "SELECT member, quantity, CASE WHEN quantile_cont(value, 0.99) > 0 THEN quantile_cont(value, 0.99) ELSE 1 END AS valid_max FROM sw_long GROUP BY 1, 2",
    doubles="valid_max",
    digits=4,
)


def _storm_class_rates(t):
    """Rate, frequency and intensity by storm size class and cell, months and hours pooled."""
    return gv.class_rates(*by_size(t))


register(
    "Q14_rate_by_storm_class",
    _storm_class_rates,
    """SELECT lat_bin, lon_bin, class, coalesce(r, 0) / v AS rate, coalesce(c, 0) / v AS freq, r / c AS intensity FROM (SELECT lat_bin, lon_bin, sum(n_views) AS v FROM obs_views GROUP BY ALL) AS n
       CROSS JOIN size_classes LEFT JOIN (SELECT lat_bin, lon_bin, class, sum(rain_sum) AS r, sum(raining_count) AS c FROM obs_size GROUP BY ALL) w USING (lat_bin, lon_bin, class)""",
    doubles="rate freq intensity",
    longs="lat_bin lon_bin class",
    digits=9,
)
register(
    "Q14_field_summer_afternoon",
    lambda t: cl.field(gridding.marginals(obs_grids(t)[0]), obs_grids(t)[1], "raintype", 1, "rate", [6, 7, 8], range(12, 18), 5),
    """SELECT lat_bin, lon_bin, coalesce(r, 0) / v AS rate FROM (SELECT lat_bin, lon_bin, sum(n_views) AS v FROM obs_views WHERE month IN (6, 7, 8) AND hour BETWEEN 12 AND 17 GROUP BY ALL) AS n
       LEFT JOIN (SELECT lat_bin, lon_bin, sum(rain_sum) AS r FROM obs_rain WHERE raintype = 1 AND month IN (6, 7, 8) AND hour BETWEEN 12 AND 17 GROUP BY ALL) w USING (lat_bin, lon_bin) WHERE v >= 5""",
    doubles="rate",
    longs="lat_bin lon_bin",
    digits=9,
)

# --- grid analyses --------------------------------------------------------

_LATC, _LONC = "(-90.0 + (lat_bin + 0.5) * 5.0)", "(-180.0 + (lon_bin + 0.5) * 5.0)"
_W = f"cos(radians({_LATC}))"
_LST = f"((hour + CAST(round_even({_LONC} / 15.0, 0) AS BIGINT)) % 24 + 24) % 24"
register(
    "R1_coarsen",
    lambda t: gv.coarsen(obs_totals(t), 3, _POOL, band=(-38.0, 38.0), deg=BIG, keys=("mission",)),
    """SELECT mission, (lat_bin - 10) // 3 AS row, lon_bin // 3 AS col, sum(rain_sum) AS rain_sum, sum(raining) AS raining, sum(n_views) AS n_views,
       -90.0 + (10 + ((lat_bin - 10) // 3 + 0.5) * 3) * 5.0 AS lat, -180.0 + (lon_bin // 3 + 0.5) * 3 * 5.0 AS lon
       FROM obs_totals WHERE lat_bin BETWEEN 10 AND 24 AND lon_bin < 72 GROUP BY ALL""",
    doubles="rain_sum lat lon",
    longs="row col raining n_views",
)
register(
    "R2_pyramid",
    lambda t: gv.pyramid(obs_totals(t), (1, 2, 4), _POOL, band=(-38.0, 38.0), deg=BIG, keys=("mission",)),
    " UNION ALL ".join(
        f"SELECT mission, {f} AS factor, (lat_bin - 10) // {f} AS row, lon_bin // {f} AS col, sum(rain_sum) AS rain_sum, sum(raining) AS raining, sum(n_views) AS n_views "
        f"FROM obs_totals WHERE lat_bin BETWEEN 10 AND {10 + 16 // f * f - 1} AND lon_bin < {72 // f * f} GROUP BY ALL"
        for f in (1, 2, 4)
    ),
    doubles="rain_sum",
    longs="factor row col raining n_views",
)
register(
    "R3_seasonal_cycle",
    lambda t: gv.seasonal_cycle(*by_size(t), deg=BIG, by=("mission",)),
    f"""SELECT mission, month, class, coalesce(r, 0) / v AS rate, coalesce(c, 0) / v AS freq FROM (SELECT mission, month, sum({_W} * n_views) AS v FROM obs_views WHERE lat_bin BETWEEN 12 AND 24 GROUP BY ALL) AS b CROSS JOIN size_classes
        LEFT JOIN (SELECT mission, month, class, sum({_W} * rain_sum) AS r, sum({_W} * raining_count) AS c FROM obs_size WHERE lat_bin BETWEEN 12 AND 24 GROUP BY ALL) a USING (mission, month, class)""",
    doubles="rate freq",
    longs="month class",
    digits=9,
)
register(
    "R4_diurnal_cycle",
    lambda t: gv.diurnal_cycle_lst(*by_size(t), deg=BIG),
    f"""SELECT lst, class, coalesce(wr, 0) / w AS rate FROM (SELECT {_LST} AS lst, sum({_W}) AS w FROM vh GROUP BY 1) AS b CROSS JOIN size_classes
        LEFT JOIN (SELECT {_LST} AS lst, class, sum({_W} * r / v) AS wr FROM (SELECT {CH}, class, sum(rain_sum) AS r FROM obs_size GROUP BY ALL) AS x JOIN vh USING ({CH}) GROUP BY 1, 2) a USING (lst, class)""",
    doubles="rate",
    longs="lst class",
    digits=9,
)
CTES["vh"] = f"SELECT {CH}, sum(n_views) AS v FROM obs_views GROUP BY ALL HAVING sum(n_views) >= 5"
register(
    "R5_W6_peak_hour",
    lambda t: gv.peak_hour_map(*obs_grids(t), deg=BIG),
    f"""SELECT lat_bin, lon_bin, {_LST} AS peak_lst, mean_rate FROM (SELECT lat_bin, lon_bin, max(struct_pack(r := rate, h := -hour)).h * -1 AS hour, avg(rate) AS mean_rate FROM (
        SELECT {CH}, coalesce(r, 0) / v AS rate FROM vh LEFT JOIN (SELECT {CH}, sum(rain_sum) AS r FROM obs_rain GROUP BY ALL) x USING ({CH})) AS h GROUP BY 1, 2) AS p WHERE mean_rate > 0.02""",
    doubles="mean_rate",
    longs="lat_bin lon_bin peak_lst",
    digits=9,
)
register(
    "R6_zonal_mean",
    lambda t: gv.zonal_mean(*by_size(t), by=("mission",)),
    """SELECT mission, lat_bin, class, coalesce(r, 0) / v AS rate FROM (SELECT mission, lat_bin, sum(n_views) AS v FROM obs_views GROUP BY ALL) AS b CROSS JOIN size_classes
       LEFT JOIN (SELECT mission, lat_bin, class, sum(rain_sum) AS r FROM obs_size GROUP BY ALL) a USING (mission, lat_bin, class)""",
    doubles="rate",
    longs="lat_bin class",
    digits=9,
)
register(
    "R6_zonal_mean_dry",
    # a record without any rain: every viewed latitude has zeros
    lambda t: gv.zonal_mean(by_size(t)[0].limit(0), by_size(t)[1], by=("mission",)),
    "SELECT mission, lat_bin, class, 0.0 AS rate FROM (SELECT DISTINCT mission, lat_bin FROM obs_views) AS b CROSS JOIN size_classes",
    doubles="rate",
    longs="lat_bin class",
)
register(
    "R7_class_fraction",
    lambda t: gv.class_fraction_by_lat(by_size(t)[0], by=("mission",)),
    """SELECT mission, lat_bin, class, r / sum(r) OVER (PARTITION BY mission, lat_bin) AS frac FROM (SELECT mission, lat_bin, class, sum(rain_sum) AS r FROM obs_size GROUP BY ALL) AS a""",
    doubles="frac",
    longs="lat_bin class",
    digits=9,
)
register(
    "R9_hovmoller",
    lambda t: gv.hovmoller(*obs_grids(t)),
    """SELECT month, lat_bin, avg(coalesce(r, 0) / v) AS rate FROM (SELECT month, lat_bin, lon_bin, sum(n_views) AS v FROM obs_views GROUP BY ALL) AS n
       LEFT JOIN (SELECT month, lat_bin, lon_bin, sum(rain_sum) AS r FROM obs_rain GROUP BY ALL) w USING (month, lat_bin, lon_bin) WHERE v >= 5 GROUP BY 1, 2""",
    doubles="rate",
    longs="month lat_bin",
    digits=9,
)
register(
    "R10_diurnal_contrast",
    lambda t: gv.diurnal_contrast(*obs_grids(t), range(12, 18), range(0, 6)),
    """SELECT lat_bin, lon_bin, a AS value_a, b AS value_b, a - b AS contrast FROM (SELECT lat_bin, lon_bin, coalesce(ra, 0) / va AS a, coalesce(rb, 0) / vb AS b FROM (
       SELECT lat_bin, lon_bin, sum(n_views) FILTER (WHERE hour BETWEEN 12 AND 17) AS va, sum(n_views) FILTER (WHERE hour < 6) AS vb FROM obs_views GROUP BY 1, 2) AS n
       LEFT JOIN (SELECT lat_bin, lon_bin, sum(rain_sum) FILTER (WHERE hour BETWEEN 12 AND 17) AS ra, sum(rain_sum) FILTER (WHERE hour < 6) AS rb FROM obs_rain GROUP BY 1, 2) w USING (lat_bin, lon_bin)) AS c
       WHERE a - b IS NOT NULL""",
    doubles="value_a value_b contrast",
    longs="lat_bin lon_bin",
    digits=9,
)
CTES["boxes"] = " UNION ALL ".join(
    f"""SELECT {f} AS factor, (lat_bin - 4) // {f} AS row, lon_bin // {f} AS col, sum(rain_sum) AS r, sum(raining) AS c, sum(n_views) AS v
    FROM obs_totals WHERE lat_bin BETWEEN 4 AND {4 + 28 // f * f - 1} AND lon_bin < {72 // f * f} GROUP BY ALL"""
    for f in (1, 2, 5)
)
register(
    "R11_resolution_curve",
    lambda t: gv.resolution_curve(*obs_grids(t), factors=(1, 2, 5), deg=BIG),
    """SELECT factor, factor * 5.0 AS box_deg, avg(CASE WHEN v >= 10 THEN r / v END) AS mean_rate, avg(CASE WHEN v >= 10 AND r / v > 0.005 THEN r / c END) AS cond_rate,
       count(*) FILTER (WHERE v >= 10 AND r / v > 0.005) / CAST((28 // factor) * (72 // factor) AS DOUBLE) AS wet_frac FROM boxes GROUP BY factor""",
    doubles="box_deg mean_rate cond_rate wet_frac",
    longs="factor",
    digits=9,
)
register(
    "R12_rate_pdf",
    lambda t: gv.rate_pdf(*obs_grids(t), factors=(1, 2, 5), hi_exp=2.0, deg=BIG),
    """SELECT factor, b, n, n / (sum(n) OVER (PARTITION BY factor) * (power(10.0, -3 + (b + 1) * st) - power(10.0, -3 + b * st))) AS density FROM (
       SELECT factor, CAST(greatest(0, least(58, floor((log10(r / v) + 3) / (CAST(5 AS DOUBLE) / 59)))) AS BIGINT) AS b, count(*) AS n, any_value(CAST(5 AS DOUBLE) / 59) AS st
       FROM boxes WHERE v >= 10 AND r > 0 AND r / v BETWEEN 0.001 AND 100 GROUP BY 1, 2) AS h""",
    doubles="density",
    longs="factor b n",
    digits=9,
)
register(
    "R13_member_zonal",
    lambda t: gv.member_zonal(cl.pooled_members(obs_totals(t), deg=BIG)),
    "SELECT member, lat_bin, sum(rain_sum) / sum(n_views) AS rate FROM obs_pool GROUP BY 1, 2 HAVING sum(n_views) >= 50",
    doubles="rate",
    longs="lat_bin",
    digits=9,
)
register(
    "R14_regional_zoom",
    lambda t: gv.regional_zoom(cl.pooled_members(obs_totals(t), deg=BIG), lon=(-40.0, 30.0), deg=BIG),
    f"""SELECT lat_bin, lon_bin, {_q('rain_sum', 'n_views', _SEEN)} AS uncond, 100 * {_q('raining', 'n_views', _SEEN)} AS freq, {_q('rain_sum', 'raining', 'raining >= 1')} AS cond
        FROM obs_pool WHERE member = 'COMBINED' AND {_LATC} BETWEEN -12 AND 12 AND {_LONC} BETWEEN -40 AND 30""",
    doubles="uncond freq cond",
    longs="lat_bin lon_bin",
    digits=9,
)
