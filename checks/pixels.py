"""Swath operators: labelling, features, echo tops, co-location, environment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CTES, f32, hav, register
from rainloom import constants as C
from rainloom import schemas
from rainloom.operators import colocate, echotops, environment, features, geometry, labels
from rainloom.session import growing, materialize

FK = "mission, orbit, local_label"

CTES["img0"] = """
SELECT mission, orbit, scan, ray, e, latd, lond, unnest(['85_89', '37']) AS channel FROM px"""
CTES["img"] = """
SELECT mission, orbit, channel, scan, ray, latd + s AS lat, CASE WHEN lond + s >= 180.0 THEN lond + s - 360.0 ELSE lond + s END AS lon,
       tc_v, tc_h, CASE WHEN tc_v > -9000 THEN CASE channel WHEN '37' THEN CAST(2.15 AS DOUBLE) * tc_v - CAST(1.15 AS DOUBLE) * tc_h
            ELSE CAST(1.818 AS DOUBLE) * tc_v - CAST(0.818 AS DOUBLE) * tc_h END END AS pct,
       latd - CAST(0.04 AS DOUBLE) * scan + CAST(0.04 AS DOUBLE) * scan + CASE WHEN (orbit // 2) % 2 = 0 THEN 0.5 ELSE -0.5 END AS sc_lat,
       lond - CAST(0.04 AS DOUBLE) * ray + CAST(0.96 AS DOUBLE) AS sc_lon
FROM (SELECT *, CASE channel WHEN '37' THEN CAST(0.021 AS DOUBLE) ELSE CAST(0.009 AS DOUBLE) END AS s,
             CASE WHEN e % 41 = 7 THEN -9999.0 ELSE CAST(2500 + (e * 31) % 400 AS DOUBLE) / 10.0 END AS tc_v,
             CAST(2300 + (e * 17) % 300 AS DOUBLE) / 10.0 AS tc_h FROM img0) AS i"""
CTES["img_dir"] = f"""
SELECT m.mission, m.orbit, m.channel, CASE WHEN d_prev IS NULL OR d_next IS NULL OR d_next < d_prev THEN -1 ELSE 1 END AS shift
FROM (SELECT mission, orbit, channel, (max(ray) + 1) // 2 AS mid FROM img GROUP BY 1, 2, 3) m
LEFT JOIN (
  SELECT s.mission, s.orbit, s.channel, avg({hav('s.sc_lat', 's.sc_lon', 'p.lat', 'p.lon')}) AS d_prev,
         avg({hav('s.sc_lat', 's.sc_lon', 'n.lat', 'n.lon')}) AS d_next
  FROM (SELECT i.*, m.mid FROM img i JOIN (SELECT mission, orbit, channel, (max(ray) + 1) // 2 AS mid FROM img GROUP BY 1, 2, 3) m
        USING (mission, orbit, channel) WHERE i.ray = m.mid) s
  JOIN img p ON p.mission = s.mission AND p.orbit = s.orbit AND p.channel = s.channel AND p.ray = s.mid AND p.scan = s.scan - 1
  JOIN img n ON n.mission = s.mission AND n.orbit = s.orbit AND n.channel = s.channel AND n.ray = s.mid AND n.scan = s.scan + 1
  GROUP BY 1, 2, 3) d ON d.mission = m.mission AND d.orbit = m.orbit AND d.channel = m.channel"""
CTES["img_shift"] = """
SELECT i.mission, i.orbit, i.channel, i.scan, i.ray, i.pct, coalesce(n.lat, i.lat) AS lat, coalesce(n.lon, i.lon) AS lon
FROM img i JOIN img_dir d ON d.mission = i.mission AND d.orbit = i.orbit AND d.channel = i.channel
LEFT JOIN img n ON n.mission = i.mission AND n.orbit = i.orbit AND n.channel = i.channel AND n.ray = i.ray AND n.scan = i.scan - d.shift"""
# Brute force: every imager pixel of the orbit, no buckets. (The lattices never lie more than 0.2 degrees of latitude apart when in reach.)
CTES["near"] = f"""
SELECT mission, orbit, scan, ray, channel, min(struct_pack(d := d, s := s_scan, r := s_ray, p := pct)) AS best FROM (
  SELECT t.mission, t.orbit, t.scan, t.ray, s.channel, s.scan AS s_scan, s.ray AS s_ray, s.pct,
         {hav('t.latd', 't.lond', 's.lat', 's.lon')} AS d
  FROM px t JOIN (SELECT mission, orbit, channel, scan, ray, lat, lon, pct, FALSE AS shifted FROM img
                  UNION ALL SELECT mission, orbit, channel, scan, ray, lat, lon, pct, TRUE FROM img_shift) s
    ON s.mission = t.mission AND s.orbit = t.orbit AND s.lat BETWEEN t.latd - 0.2 AND t.latd + 0.2
   AND s.shifted = ((storm_top > 5000 AND CAST(v % 100 AS DOUBLE) / 100.0 > CAST(0.4 AS DOUBLE)) IS TRUE)) AS c
WHERE d <= 15.0 GROUP BY 1, 2, 3, 4, 5"""
CTES["near_pct"] = f"""
SELECT mission, orbit, scan, ray, max(CASE channel WHEN '85_89' THEN {f32('best.p')} END) AS pct_85_89,
       max(CASE channel WHEN '37' THEN {f32('best.p')} END) AS pct_37 FROM near GROUP BY 1, 2, 3, 4"""

# --- labelling ------------------------------------------------------------

register(
    "C1_rain_mask",
    lambda t: labels.rain_mask(t.flat).groupBy("mission", "orbit").agg(F.count("*").alias("n")),
    "SELECT mission, orbit, count(*) AS n FROM wet GROUP BY 1, 2",
    longs="orbit n",
)
register(
    "C2_label_features",
    lambda t: t.labels.select("mission", "orbit", "scan", "ray", "local_label"),
    "SELECT mission, orbit, scan, ray, local_label FROM lab",
    longs="orbit scan ray local_label",
)
CTES["touch4"] = """
SELECT a.mission, a.orbit, a.run AS a, b.run AS b FROM runs a JOIN runs b
  ON a.mission = b.mission AND a.orbit = b.orbit AND abs(a.scan - b.scan) = 1 AND a.r0 <= b.r1 AND b.r0 <= a.r1"""
CTES["reach4"] = """
SELECT mission, orbit, run, run AS root FROM runs
UNION
SELECT t.mission, t.orbit, t.b AS run, reach4.root FROM reach4 JOIN touch4 t
  ON t.mission = reach4.mission AND t.orbit = reach4.orbit AND t.a = reach4.run WHERE reach4.root < t.b"""
register(
    "C2_C3_four_connected_min_area",
    lambda t: labels.label_features(t.flat, min_area=60.0, min_pixels=3, connectivity=1, areas=t.side),
    """SELECT l.* FROM (
         SELECT r.mission, r.orbit, r.scan, unnest(range(r.r0, r.r1 + 1)) AS ray, n.local_label FROM runs r
         JOIN (SELECT mission, orbit, run, min(root) AS root FROM reach4 GROUP BY 1, 2, 3) t
           ON r.mission = t.mission AND r.orbit = t.orbit AND r.run = t.run
         JOIN (SELECT mission, orbit, root, row_number() OVER (PARTITION BY mission, orbit ORDER BY root) AS local_label
               FROM (SELECT DISTINCT mission, orbit, min(root) AS root FROM reach4 GROUP BY mission, orbit, run) AS u) n
           ON n.mission = t.mission AND n.orbit = t.orbit AND n.root = t.root) l
       JOIN pa ON pa.mission = l.mission AND pa.orbit = l.orbit AND pa.scan = l.scan AND pa.ray = l.ray
       WINDOW w AS (PARTITION BY l.mission, l.orbit, l.local_label)
       QUALIFY count(*) OVER w >= 3 AND sum(pixel_area) OVER w >= 60.0 AND count(pixel_area) OVER w = count(*) OVER w""",
    longs="orbit scan ray local_label",
)
register(
    "C4_touches_edge",
    lambda t: labels.touches_edge(t.labels, t.flat),
    """SELECT l.mission, l.orbit, l.local_label, bool_or(l.scan = s0 OR l.scan = s1 OR l.ray = r0 OR l.ray = r1) AS edge FROM lab l
       JOIN (SELECT mission, orbit, min(scan) AS s0, max(scan) AS s1, min(ray) AS r0, max(ray) AS r1 FROM px GROUP BY 1, 2) x
       ON x.mission = l.mission AND x.orbit = l.orbit GROUP BY 1, 2, 3""",
    longs="orbit local_label",
)
register(
    "C5_footprint_area",
    lambda t: geometry.footprint_area(t.geolocation),
    "SELECT mission, orbit, scan, ray, pixel_area FROM pa",
    doubles="pixel_area",
    longs="orbit scan ray",
    digits=4,
)
register(
    "C6_isolated",
    lambda t: echotops.isolated(t.flat, t.flat, 11000.0),
    """SELECT p.mission, p.orbit, p.scan, p.ray, max(q.storm_top) <= 11000 AS isolated FROM px p JOIN px q
       ON p.mission = q.mission AND p.orbit = q.orbit AND abs(p.scan - q.scan) <= 1 AND abs(p.ray - q.ray) <= 1
       AND (p.scan <> q.scan OR p.ray <> q.ray) WHERE q.storm_top IS NOT NULL GROUP BY 1, 2, 3, 4""",
    longs="orbit scan ray",
)
register(
    "C7_parallax_shift",
    lambda t: colocate.parallax_shift(t.imager).select("mission", "orbit", "channel", "scan", "ray", "lat", "lon"),
    "SELECT mission, orbit, channel, scan, ray, lat, lon FROM img_shift",
    doubles="lat lon",
    longs="orbit scan ray",
)
register(
    "P8_channel_order",
    lambda t: colocate.check_channel_order(t.imager.withColumn("tc_v", F.when((F.col("orbit") % 2 == 1) & (F.col("tc_v") > -9000), F.col("tc_v") - 40).otherwise(F.col("tc_v")))),
    """SELECT * FROM (SELECT mission, orbit, channel,
         avg(CASE WHEN tc_v > -9000 THEN tc_v - CASE WHEN orbit % 2 = 1 THEN 40 ELSE 0 END END) AS mean_v, avg(tc_h) AS mean_h
         FROM img GROUP BY 1, 2, 3) AS m WHERE NOT mean_v > mean_h""",
    doubles="mean_v mean_h",
    longs="orbit",
)
register(
    "J4_nearest_imager_pixel",
    lambda t: colocate.nearest_within(
        t.geolocation.select("mission", "orbit", "scan", "ray", "lat", "lon", colocate.parallax_gate().alias("shifted")),
        t.imager.where("channel = '37'").select("mission", "orbit", "scan", "ray", "lat", "lon", "pct", F.lit(False).alias("shifted"))
        .unionByName(
            colocate.parallax_shift(t.imager.where("channel = '37'")).select(
                "mission", "orbit", "scan", "ray", "lat", "lon", "pct", F.lit(True).alias("shifted"))
        ),
        "pct", group=("mission", "orbit", "shifted"),
    ).select("mission", "orbit", "scan", "ray", "pct", "distance_km", "source_scan", "source_ray"),
    """SELECT mission, orbit, scan, ray, best.p AS pct, best.d AS distance_km, best.s AS source_scan, best.r AS source_ray
       FROM near WHERE channel = '37'""",
    doubles="pct distance_km",
    longs="orbit scan ray source_scan source_ray",
    digits=4,
)
register(
    "J5_parallax_gated_pct",
    lambda t: t.side.drop("pixel_area"),
    """SELECT p.mission, p.orbit, p.scan, p.ray, n.pct_85_89, n.pct_37 FROM px p LEFT JOIN near_pct n
       ON n.mission = p.mission AND n.orbit = p.orbit AND n.scan = p.scan AND n.ray = p.ray""",
    doubles="pct_85_89 pct_37",
    longs="orbit scan ray",
    digits=3,
)

# --- per-feature aggregates -----------------------------------------------


def _members(fn):
    return lambda t: fn(t.members)


register(
    "A1_extent",
    _members(features.feature_extent),
    f"""SELECT {FK}, count(*) AS npixels, sum(pixel_area) AS area_km2, min(scan) AS bbox_scan_min, max(scan) AS bbox_scan_max,
        min(ray) AS bbox_ray_min, max(ray) AS bbox_ray_max FROM mem GROUP BY ALL""",
    doubles="area_km2",
    longs="orbit local_label npixels bbox_scan_min bbox_scan_max bbox_ray_min bbox_ray_max",
    digits=3,
)
register(
    "A2_time",
    _members(features.feature_time),
    f"SELECT {FK}, sum(CAST(epoch_us(time) AS HUGEINT)) // count(*) AS time FROM mem GROUP BY ALL",
    longs="orbit local_label time",
)
_CEN = """sum(pixel_area * lat) / sum(pixel_area) AS centroid_lat,
        degrees(atan2(sum(pixel_area * sin(radians(lon))), sum(pixel_area * cos(radians(lon))))) AS centroid_lon"""
register(
    "A3_centroid",
    _members(features.feature_centroid),
    f"SELECT {FK}, {_CEN} FROM mem GROUP BY ALL",
    doubles="centroid_lat centroid_lon",
    longs="orbit local_label",
    digits=5,
)
CTES["mem_c"] = f"SELECT m.*, c.centroid_lon FROM mem m JOIN (SELECT {FK}, {_CEN} FROM mem GROUP BY ALL) c USING ({FK})"
_DL = "(lon - centroid_lon + 180.0 - floor((lon - centroid_lon + 180.0) / 360.0) * 360.0 - 180.0)"


def _wrap(x):
    return f"({x} + 180.0 - floor(({x} + 180.0) / 360.0) * 360.0 - 180.0)"


register(
    "A4_bbox",
    _members(features.feature_bbox),
    f"""SELECT {FK}, min(lat) AS bbox_lat_min, max(lat) AS bbox_lat_max,
        {_wrap(f'(min(centroid_lon) + min({_DL}))')} AS bbox_lon_min, {_wrap(f'(min(centroid_lon) + max({_DL}))')} AS bbox_lon_max
        FROM mem_c GROUP BY {FK}""",
    doubles="bbox_lat_min bbox_lat_max bbox_lon_min bbox_lon_max",
    longs="orbit local_label",
    digits=5,
)
register(
    "A5_surface",
    _members(features.feature_surface),
    f"""SELECT {FK}, land / nullif(n, 0) AS frac_land, ocean / nullif(n, 0) AS frac_ocean, coast / nullif(n, 0) AS frac_coast,
        CASE WHEN n = 0 THEN -1 WHEN ocean >= land AND ocean >= coast THEN 0 WHEN land >= coast THEN 1 ELSE 2 END AS surface_flag
        FROM (SELECT {FK}, count(*) FILTER (WHERE surface_type BETWEEN 0 AND 99) AS ocean, count(*) FILTER (WHERE surface_type BETWEEN 100 AND 199) AS land,
              count(*) FILTER (WHERE surface_type >= 200) AS coast, count(*) FILTER (WHERE surface_type >= 0) AS n FROM mem GROUP BY ALL) AS s""",
    doubles="frac_land frac_ocean frac_coast",
    longs="orbit local_label surface_flag",
)
register(
    "A6_near_surface",
    _members(features.feature_rain),
    f"""SELECT {FK}, max(near_sfc_dbz) AS max_near_sfc_dbz, max(near_sfc_rain) AS max_near_sfc_rain, avg(near_sfc_rain) AS mean_near_sfc_rain
        FROM mem GROUP BY ALL""",
    doubles="max_near_sfc_dbz max_near_sfc_rain mean_near_sfc_rain",
    longs="orbit local_label",
    digits=5,
)
register(
    "A7_volume_rain",
    _members(features.feature_volume),
    f"SELECT {FK}, sum(near_sfc_rain * pixel_area) AS volrain_total FROM mem GROUP BY ALL",
    doubles="volrain_total",
    longs="orbit local_label",
    digits=3,
)
_K = "(pi() * 6371.0 / 180.0)"
CTES["mem_u"] = f"""
SELECT m.*, ref + (lon - ref + 180.0 - floor((lon - ref + 180.0) / 360.0) * 360.0 - 180.0) AS lon_u
FROM (SELECT *, first_value(lon) OVER (PARTITION BY {FK} ORDER BY scan, ray) AS ref FROM mem) AS m"""
CTES["cov"] = f"""
SELECT {FK}, n, vlon * k * k AS cxx, vlat * {_K} * {_K} AS cyy, clon * k * {_K} AS cxy FROM (
  SELECT {FK}, count(*) AS n, var_pop(lon_u) AS vlon, var_pop(lat) AS vlat, covar_pop(lon_u, lat) AS clon,
         cos(radians(avg(lat))) * {_K} AS k FROM mem_u GROUP BY ALL) AS c"""
CTES["axes"] = f"""
SELECT *, 4 * sqrt(greatest(0, m + r)) AS major, 4 * sqrt(greatest(0, m - r)) AS minor FROM (
  SELECT *, (cxx + cyy) / 2 AS m, sqrt(power((cxx - cyy) / 2, 2) + power(cxy, 2)) AS r FROM cov) AS e"""
# The angle of a nearly round feature hangs on rounding errors, and so does the minor axis of a collinear one.
# What is compared instead changes smoothly everywhere and keeps the sign of the angle: the elongation along
# both diagonals of the double angle, and the squares of the minor axis and of the inverse aspect ratio.
_AXES = """CASE WHEN n < 2 THEN 0 ELSE major END AS major_axis_km, CASE WHEN n < 2 THEN 0 ELSE minor * minor END AS minor2,
        CASE WHEN n < 2 OR major <= 0 THEN 0 ELSE (1 - minor / major) * cos(atan2(2 * cxy, cxx - cyy)) END AS elongation_cos,
        CASE WHEN n < 2 OR major <= 0 THEN 0 ELSE (1 - minor / major) * sin(atan2(2 * cxy, cxx - cyy)) END AS elongation_sin,
        CASE WHEN n < 2 OR major <= 0 THEN 1 ELSE greatest(power(greatest(minor, 0.001) / major, 2), 1e-8) END AS thinness"""

_THIN = "(n <= 1 OR minor <= 0.001 OR major / greatest(minor, 0.001) >= 10000)"


def smooth_axes(df):
    major, minor, twice = F.col("major_axis_km"), F.col("minor_axis_km"), F.radians("orientation_deg") * 2
    stretch = F.when(major > 0, 1 - minor / major).otherwise(0.0)
    return df.withColumns(
        {"minor2": minor * minor, "elongation_cos": stretch * F.cos(twice), "elongation_sin": stretch * F.sin(twice), "thinness": 1 / (F.col("aspect_ratio") * F.col("aspect_ratio"))}
    ).drop("minor_axis_km", "orientation_deg", "aspect_ratio")


register(
    "A8_axes",
    lambda t: smooth_axes(features.feature_axes(t.members)).select("mission", "orbit", "local_label", "major_axis_km", "minor2", "elongation_cos", "elongation_sin", "thinness"),
    f"SELECT {FK}, {_AXES} FROM axes",
    doubles="major_axis_km minor2 elongation_cos elongation_sin thinness",
    longs="orbit local_label",
    digits=3,
)
register(
    "A9_eccentricity",
    _members(features.feature_eccentricity),
    f"""SELECT {FK}, CASE WHEN m + r > 0 THEN sqrt(1 - greatest(0, m - r) / (m + r)) ELSE 0 END AS eccentricity FROM (
        SELECT {FK}, (vs + vr) / 2 AS m, sqrt(power((vs - vr) / 2, 2) + power(c, 2)) AS r FROM (
        SELECT {FK}, var_pop(scan) AS vs, var_pop(ray) AS vr, covar_pop(scan, ray) AS c FROM mem GROUP BY ALL) AS a) AS b""",
    doubles="eccentricity",
    longs="orbit local_label",
    digits=5,
)
register(
    "A10_thin",
    lambda t: features.feature_thin(t.members).join(
        growing(features.feature_extent(t.members).select("mission", "orbit", "local_label", "npixels")), ["mission", "orbit", "local_label"]
    ).groupBy("npixels").agg(F.count_if("is_thin").alias("thin"), F.count("*").alias("n")),
    f"""SELECT n AS npixels, count(*) FILTER (WHERE {_THIN}) AS thin, count(*) AS n
        FROM axes GROUP BY axes.n""",
    longs="npixels thin n",
)
register(
    "A11_min_pct",
    _members(features.feature_min_pct),
    f"""SELECT {FK}, min(pct_85_89) AS min_pct_85_89, min(pct_37) AS min_pct_37 FROM lab LEFT JOIN near_pct USING (mission, orbit, scan, ray) GROUP BY {FK}""",
    doubles="min_pct_85_89 min_pct_37",
    longs="orbit local_label",
    digits=3,
)
register(
    "A12_conv_strat",
    _members(features.feature_conv_strat),
    f"""SELECT *, conv_area_km2 / a AS conv_area_frac, strat_area_km2 / a AS strat_area_frac,
        CASE WHEN v > 0 THEN volrain_conv / v END AS conv_rain_frac, CASE WHEN v > 0 THEN volrain_strat / v END AS strat_rain_frac
        FROM (SELECT {FK}, coalesce(sum(pixel_area) FILTER (WHERE rain_type = 2), 0) AS conv_area_km2,
        coalesce(sum(pixel_area) FILTER (WHERE rain_type = 1), 0) AS strat_area_km2,
        coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 2), 0) AS volrain_conv,
        coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 1), 0) AS volrain_strat,
        sum(pixel_area) AS a, sum(near_sfc_rain * pixel_area) AS v FROM mem GROUP BY {FK}) AS s""".replace("SELECT *, conv", f"SELECT {FK}, conv_area_km2, strat_area_km2, volrain_conv, volrain_strat, conv", 1),
    doubles="conv_area_km2 strat_area_km2 volrain_conv volrain_strat conv_area_frac strat_area_frac conv_rain_frac strat_rain_frac",
    longs="orbit local_label",
    digits=3,
)
register(
    "A13_level_heights",
    _members(features.feature_heights),
    f"SELECT {FK}, avg(bb_height) AS mean_bb_height, avg(freezing_level) AS mean_freezing_level FROM mem GROUP BY ALL",
    doubles="mean_bb_height mean_freezing_level",
    longs="orbit local_label",
    digits=4,
)
register(
    "A14_feature_class",
    lambda t: features.feature_class(t.members).groupBy("mission", "feature_class", "is_mcs").agg(F.count("*").alias("n")),
    f"""SELECT mission, CASE WHEN a >= 2000 THEN 'MCS' WHEN c > 0 THEN 'sub_MCS_conv' WHEN s > 0 THEN 'stratiform_only' ELSE 'weak' END AS feature_class,
        a >= 2000 AS is_mcs, count(*) AS n FROM (SELECT {FK}, sum(pixel_area) AS a, coalesce(sum(pixel_area) FILTER (WHERE rain_type = 2), 0) AS c,
        coalesce(sum(pixel_area) FILTER (WHERE rain_type = 1), 0) AS s FROM mem GROUP BY ALL) AS x GROUP BY 1, 2, 3""",
    longs="n",
)

# --- echo tops ------------------------------------------------------------
# Bin j above the ground: height j * 125 m * cos(zenith), 46.0 - 0.2 j + (v % 7) dBZ, up to top_j.

CTES["bins"] = f"""
SELECT *, {f32('j * 125.0 * cosz')} AS h, {f32('CAST(460 - j * 2 + (v % 7) * 10 AS DOUBLE) / 10.0')} AS z,
       CAST((j * 7 + v) % 23 AS DOUBLE) / 2.0 AS rate, (ray < 8 OR ray > 42) AS is_outer,
       CASE WHEN mirror BETWEEN 0 AND 175 THEN {f32('(175 - mirror) * 125.0 * cosz')} ELSE CAST('inf' AS DOUBLE) END AS mirror_h
FROM (SELECT mission, orbit, scan, ray, v, rain_type, storm_top, mirror, top_j, cos(radians(local_zenith)) AS cosz, unnest(range(0, top_j + 1)) AS j FROM px) AS b"""
CTES["raw_best"] = f"""
SELECT {FK}, t, max(struct_pack(h := h, s := -b.scan, r := -b.ray)) AS best FROM (SELECT *, unnest([20, 30, 40]) AS t FROM bins) b
JOIN lab USING (mission, orbit, scan, ray) WHERE z >= t GROUP BY ALL"""
_RAWCOLS = ", ".join(
    f"max(best.h) FILTER (WHERE t = {t}) AS raw_ht_{t}dbz, coalesce(-max(best.s) FILTER (WHERE t = {t}), -1) AS raw_ht_{t}dbz_scan, "
    f"coalesce(-max(best.r) FILTER (WHERE t = {t}), -1) AS raw_ht_{t}dbz_ray"
    for t in (20, 30, 40)
)
_RL = " ".join(f"raw_ht_{t}dbz_scan raw_ht_{t}dbz_ray" for t in (20, 30, 40))
register(
    "A15_raw_echo_tops",
    lambda t: echotops.raw_echo_tops(features.join_members(t.swath, t.labels, echo=False)),
    f"SELECT {FK}, {_RAWCOLS} FROM (SELECT DISTINCT {FK} FROM lab) f LEFT JOIN raw_best USING ({FK}) GROUP BY {FK}",
    doubles="raw_ht_20dbz raw_ht_30dbz raw_ht_40dbz",
    longs=f"orbit local_label {_RL}",
    digits=2,
)
# The peel is run attempt by attempt: four rounds of "take the highest kept 20 dBZ bin, peel if high and isolated".
CTES["fbins"] = f"""
SELECT b.*, l.local_label, h > 15000 AS high, (h > 15000 AND (is_outer OR h > mirror_h)) AS rejected FROM bins b JOIN lab l USING (mission, orbit, scan, ray)"""
CTES["lone"] = """
SELECT p.mission, p.orbit, p.scan, p.ray, max(q.storm_top) <= 15000 AS lone FROM px p JOIN px q
  ON p.mission = q.mission AND p.orbit = q.orbit AND abs(p.scan - q.scan) <= 1 AND abs(p.ray - q.ray) <= 1
 AND (p.scan <> q.scan OR p.ray <> q.ray) WHERE q.storm_top IS NOT NULL GROUP BY 1, 2, 3, 4"""


def _attempt(i: int) -> None:
    prior = "".join(
        f" AND NOT (high AND EXISTS (SELECT 1 FROM try{k} p WHERE p.mission = f.mission AND p.orbit = f.orbit AND p.local_label = f.local_label"
        f" AND p.s = -f.scan AND p.r = -f.ray AND p.peel))"
        for k in range(1, i)
    )
    alive = "" if i == 1 else f" JOIN (SELECT {FK} FROM try{i - 1} WHERE peel) g USING ({FK})"
    CTES[f"try{i}"] = f"""
SELECT a.mission, a.orbit, a.local_label, best.h AS h, best.s AS s, best.r AS r, best.nb AS nb, best.h > 15000 AND coalesce(lone, FALSE) AS peel FROM (
  SELECT {FK}, max(struct_pack(h := h, s := -scan, r := -ray, nb := j)) AS best FROM fbins f{alive}
  WHERE z >= 20 AND NOT rejected{prior} GROUP BY {FK}) AS a
LEFT JOIN lone ON lone.mission = a.mission AND lone.orbit = a.orbit AND lone.scan = -a.best.s AND lone.ray = -a.best.r"""


for _i in range(1, 5):
    _attempt(_i)
CTES["peels"] = " UNION ALL ".join(f"SELECT {FK}, s, r FROM try{i} WHERE peel" for i in range(1, 5))
CTES["tops"] = " UNION ALL ".join(f"SELECT {FK}, h, s, r, nb FROM try{i} WHERE NOT peel" for i in range(1, 5))
CTES["qc_best"] = f"""
SELECT {FK}, t, max(struct_pack(h := h, s := -f.scan, r := -f.ray)) AS best FROM (SELECT *, unnest([20, 30, 40]) AS t FROM fbins) f
JOIN (SELECT {FK} FROM tops) k USING ({FK})
LEFT JOIN (SELECT mission, orbit, local_label, -s AS scan, -r AS ray, TRUE AS hit FROM peels) p USING (mission, orbit, local_label, scan, ray)
WHERE z >= t AND NOT rejected AND NOT (high AND coalesce(p.hit, FALSE)) GROUP BY {FK}, t"""
CTES["dd_flag"] = f"""
SELECT {FK}, max(rate) FILTER (WHERE j = nb) >= max(rate) FILTER (WHERE j <> nb AND high) AS dd
FROM fbins f JOIN tops t USING ({FK}) WHERE f.scan = -t.s AND f.ray = -t.r GROUP BY {FK}"""
_QC = ", ".join(
    f"max(best.h) FILTER (WHERE t = {t}) AS max_ht_{t}dbz, coalesce(-max(best.s) FILTER (WHERE t = {t}), -1) AS max_ht_{t}dbz_scan, "
    f"coalesce(-max(best.r) FILTER (WHERE t = {t}), -1) AS max_ht_{t}dbz_ray"
    for t in (20, 30, 40)
)
CTES["qc"] = f"""
SELECT {FK}, w.* EXCLUDE ({FK}), CASE mission WHEN 'GPM' THEN 19000.0 ELSE 18000.0 END AS ceiling, f.cut_s, f.cut_m,
       EXISTS (SELECT 1 FROM peels p WHERE p.mission = f.mission AND p.orbit = f.orbit AND p.local_label = f.local_label) AS peeled
FROM (SELECT {FK}, bool_or(z >= 20 AND high AND is_outer) AS cut_s, bool_or(z >= 20 AND high AND h > mirror_h) AS cut_m FROM fbins GROUP BY {FK}) f
LEFT JOIN (SELECT {FK}, {_QC} FROM qc_best GROUP BY {FK}) w USING ({FK})"""
CTES["qc_out"] = f"""
SELECT q.mission, q.orbit, q.local_label, max_ht_20dbz, coalesce(max_ht_20dbz_scan, -1) AS max_ht_20dbz_scan, coalesce(max_ht_20dbz_ray, -1) AS max_ht_20dbz_ray,
       max_ht_30dbz, coalesce(max_ht_30dbz_scan, -1) AS max_ht_30dbz_scan, coalesce(max_ht_30dbz_ray, -1) AS max_ht_30dbz_ray,
       max_ht_40dbz, coalesce(max_ht_40dbz_scan, -1) AS max_ht_40dbz_scan, coalesce(max_ht_40dbz_ray, -1) AS max_ht_40dbz_ray,
       cut_s::INT * 16 + cut_m::INT * 8 + peeled::INT * 32 + coalesce((max_ht_20dbz > 15000 AND dd)::INT, 0) * 2
       + coalesce((max_ht_20dbz > 15000 AND max_ht_20dbz >= ceiling - 125)::INT, 0) * 129
       + coalesce((max_ht_20dbz > 15000 AND max_ht_20dbz >= ceiling - 125 AND dd)::INT, 0) * 64 AS echotop_qc_flags,
       coalesce(max_ht_20dbz > 15000 AND max_ht_20dbz >= ceiling - 125, FALSE) AS max_ht_20dbz_censored,
       CASE WHEN max_ht_20dbz IS NOT NULL THEN ceiling END AS ray_obs_ceiling_m
FROM qc q LEFT JOIN dd_flag d ON d.mission = q.mission AND d.orbit = q.orbit AND d.local_label = q.local_label"""
_QL = " ".join(f"max_ht_{t}dbz_scan max_ht_{t}dbz_ray" for t in (20, 30, 40))
register(
    "A16_qc_echo_tops",
    lambda t: echotops.qc_echo_tops(t.members, t.flat),
    "SELECT * FROM qc_out",
    doubles="max_ht_20dbz max_ht_30dbz max_ht_40dbz ray_obs_ceiling_m",
    longs=f"orbit local_label echotop_qc_flags {_QL}",
    digits=2,
)
register(
    "G6_pixel_echo_tops",
    lambda t: echotops.pixel_echo_tops(t.swath).select("mission", "orbit", "scan", "ray", "top_20", "top_30", "top_40"),
    """SELECT p.mission, p.orbit, p.scan, p.ray, top_20, top_30, top_40 FROM px p LEFT JOIN (
       SELECT mission, orbit, scan, ray, max(h) FILTER (WHERE z >= 20) AS top_20, max(h) FILTER (WHERE z >= 30) AS top_30,
       max(h) FILTER (WHERE z >= 40) AS top_40 FROM bins WHERE NOT (h > 15000 AND (is_outer OR h > mirror_h)) GROUP BY 1, 2, 3, 4) b
       USING (mission, orbit, scan, ray)""",
    doubles="top_20 top_30 top_40",
    longs="orbit scan ray",
    digits=2,
)

# --- assembled tables -----------------------------------------------------

register(
    "A17_feature_table",
    lambda t: smooth_axes(t.swath_features),
    f"""SELECT CASE f.mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + f.orbit * 100000 + f.local_label AS feature_id,
        f.*, q.* EXCLUDE ({FK}), x.* EXCLUDE ({FK}), ec.eccentricity, ed.edge
        FROM (
          SELECT {FK}, sum(CAST(epoch_us(time) AS HUGEINT)) // count(*) AS time, count(*) AS npixels, sum(pixel_area) AS area_km2, {_CEN},
            min(scan) AS bbox_scan_min, max(scan) AS bbox_scan_max, min(ray) AS bbox_ray_min, max(ray) AS bbox_ray_max,
            min(lat) AS bbox_lat_min, max(lat) AS bbox_lat_max,
            {_wrap(f'(min(centroid_lon) + min({_DL}))')} AS bbox_lon_min, {_wrap(f'(min(centroid_lon) + max({_DL}))')} AS bbox_lon_max,
            count(*) FILTER (WHERE surface_type BETWEEN 100 AND 199) / nullif(count(*) FILTER (WHERE surface_type >= 0), 0) AS frac_land,
            count(*) FILTER (WHERE surface_type BETWEEN 0 AND 99) / nullif(count(*) FILTER (WHERE surface_type >= 0), 0) AS frac_ocean,
            count(*) FILTER (WHERE surface_type >= 200) / nullif(count(*) FILTER (WHERE surface_type >= 0), 0) AS frac_coast,
            CASE WHEN count(*) FILTER (WHERE surface_type >= 0) = 0 THEN -1
                 WHEN count(*) FILTER (WHERE surface_type BETWEEN 0 AND 99) >= greatest(count(*) FILTER (WHERE surface_type BETWEEN 100 AND 199), count(*) FILTER (WHERE surface_type >= 200)) THEN 0
                 WHEN count(*) FILTER (WHERE surface_type BETWEEN 100 AND 199) >= count(*) FILTER (WHERE surface_type >= 200) THEN 1 ELSE 2 END AS surface_flag,
            max(near_sfc_dbz) AS max_near_sfc_dbz, max(near_sfc_rain) AS max_near_sfc_rain, avg(near_sfc_rain) AS mean_near_sfc_rain,
            sum(near_sfc_rain * pixel_area) AS volrain_total, min(pct_85_89) AS min_pct_85_89, min(pct_37) AS min_pct_37,
            coalesce(sum(pixel_area) FILTER (WHERE rain_type = 2), 0) AS conv_area_km2, coalesce(sum(pixel_area) FILTER (WHERE rain_type = 1), 0) AS strat_area_km2,
            coalesce(sum(pixel_area) FILTER (WHERE rain_type = 2), 0) / sum(pixel_area) AS conv_area_frac,
            coalesce(sum(pixel_area) FILTER (WHERE rain_type = 1), 0) / sum(pixel_area) AS strat_area_frac,
            coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 2), 0) / nullif(sum(near_sfc_rain * pixel_area), 0) AS conv_rain_frac,
            coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 1), 0) / nullif(sum(near_sfc_rain * pixel_area), 0) AS strat_rain_frac,
            coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 2), 0) AS volrain_conv,
            coalesce(sum(near_sfc_rain * pixel_area) FILTER (WHERE rain_type = 1), 0) AS volrain_strat,
            avg(bb_height) AS mean_bb_height, avg(freezing_level) AS mean_freezing_level, sum(pixel_area) >= 2000 AS is_mcs,
            CASE WHEN sum(pixel_area) >= 2000 THEN 'MCS' WHEN coalesce(sum(pixel_area) FILTER (WHERE rain_type = 2), 0) > 0 THEN 'sub_MCS_conv'
                 WHEN coalesce(sum(pixel_area) FILTER (WHERE rain_type = 1), 0) > 0 THEN 'stratiform_only' ELSE 'weak' END AS feature_class
          FROM mem_c LEFT JOIN near_pct USING (mission, orbit, scan, ray) GROUP BY {FK}) f
        JOIN qc_out q USING ({FK}) JOIN (SELECT {FK}, {_AXES}, {_THIN} AS is_thin FROM axes) x USING ({FK})
        JOIN (SELECT {FK}, CASE WHEN m + r > 0 THEN sqrt(1 - greatest(0, m - r) / (m + r)) ELSE 0 END AS eccentricity FROM (
              SELECT {FK}, (vs + vr) / 2 AS m, sqrt(power((vs - vr) / 2, 2) + power(c, 2)) AS r FROM (
              SELECT {FK}, var_pop(scan) AS vs, var_pop(ray) AS vr, covar_pop(scan, ray) AS c FROM mem GROUP BY ALL) AS a) AS b) ec USING ({FK})
        JOIN (SELECT l.mission, l.orbit, l.local_label, bool_or(l.scan = s0 OR l.scan = s1 OR l.ray = r0 OR l.ray = r1) AS edge FROM lab l
              JOIN (SELECT mission, orbit, min(scan) AS s0, max(scan) AS s1, min(ray) AS r0, max(ray) AS r1 FROM px GROUP BY 1, 2) o
              ON o.mission = l.mission AND o.orbit = l.orbit GROUP BY 1, 2, 3) ed USING ({FK})""",
    doubles=" ".join(
        f.name for f in schemas.FEATURES.fields
        if f.dataType.simpleString() == "float" and f.name not in ("minor_axis_km", "orientation_deg", "aspect_ratio")
    ) + " minor2 elongation_cos elongation_sin thinness",
    longs=" ".join(
        f.name for f in schemas.FEATURES.fields if f.dataType.simpleString() in ("int", "bigint", "tinyint", "smallint", "timestamp")
    ),
    digits=2,
    single=True,
)
register(
    "A18_member_pixels",
    lambda t: features.build_pixels(t.flat, t.labels, t.members),
    """SELECT CASE m.mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + m.orbit * 100000 + m.local_label AS feature_id, m.mission, m.orbit, m.scan, m.ray,
       m.lat, m.lon, m.near_sfc_dbz, m.near_sfc_rain, n.pct_85_89, n.pct_37, m.rain_type, m.pixel_area AS pixel_area_km2, m.bb_height
       FROM mem m LEFT JOIN near_pct n USING (mission, orbit, scan, ray)""",
    doubles="lat lon near_sfc_dbz near_sfc_rain pct_85_89 pct_37 pixel_area_km2 bb_height",
    longs="feature_id orbit scan ray rain_type",
    digits=3,
)

# --- environment ----------------------------------------------------------
# Analysis cells: every hour and cell any feature of the swath looks at, with formula values.

_VARS = C.ENV_VARS


def reanalysis(t):
    """Analysis fields over the cells around the features, as formulas of hour and cell."""
    spots = environment.box_cells(environment.locate(t.swath_features), 11).select("hour", "iy", "ix").distinct()
    spots = spots.repartition(t.spark.sparkContext.defaultParallelism)
    n = (F.unix_seconds("hour") / 3600).cast("long")
    a = F.pmod(n * 7 + F.col("iy") * 13 + F.col("ix") * 29, F.lit(1009)).cast("double")
    levels = F.transform(
        F.sequence(F.lit(1), F.lit(8)),
        lambda i: F.struct(
            (F.lit(1075.0) - 75.0 * i).alias("level"),
            F.when(F.pmod(a + i, F.lit(97)) == 5, F.lit(None)).otherwise((i * 950.0 + F.pmod(a, F.lit(50))) * 9.81).alias("z"),
            (i * 2.5 + F.pmod(a, F.lit(9))).alias("u"),
            (F.lit(12.0) - i * 1.25 + F.pmod(a, F.lit(5))).alias("v"),
        ),
    )
    return spots.select(
        "hour", "iy", "ix",
        (a * 4).alias("cape"),
        F.when(F.pmod(a, F.lit(7)) != 3, -a / 8).alias("cin"),
        F.when(F.pmod(a, F.lit(3)) != 1, F.lit(290.0) + a / 64).alias("sst"),
        (F.lit(280.0) + a / 32).alias("skt"),
        (a / 1000).alias("tpr"),
        F.pmod(a, F.lit(4)).alias("u10"),
        F.pmod(a, F.lit(6)).alias("v10"),
        levels.alias("levels"),
    )


_cache: dict = {}


def cells(t):
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _cache:
        _cache[key] = materialize(environment.shear(reanalysis(t)), "analysis-cells")
    return _cache[key]


# The features' own stored (single-precision) centroids are inputs here, so cells are keyed on them.
CTES["loc"] = f"""
SELECT {FK}, make_timestamp((hr + CASE WHEN rest > 1800000000 OR (rest = 1800000000 AND hr % 2 = 1) THEN 1 ELSE 0 END) * 3600000000) AS hour, iy, ix
FROM (SELECT {FK}, us // 3600000000 AS hr, us % 3600000000 AS rest, CAST(round_even(clat / 0.25, 0) AS BIGINT) AS iy,
      (CAST(round_even((clon - floor(clon / 360.0) * 360.0) / 0.25, 0) AS BIGINT)) % 1440 AS ix
      FROM (SELECT {FK}, CAST(sum(CAST(epoch_us(time) AS HUGEINT)) // count(*) AS BIGINT) AS us, {f32('sum(pixel_area * lat) / sum(pixel_area)')} AS clat,
            {f32('degrees(atan2(sum(pixel_area * sin(radians(lon))), sum(pixel_area * cos(radians(lon)))))')} AS clon FROM mem GROUP BY {FK}) AS m) AS q"""
CTES["around"] = """
SELECT DISTINCT hour, iy0, ix0, iy0 + dy AS iy, (ix0 + dx + 1440) % 1440 AS ix, greatest(abs(dy), abs(dx)) AS ring
FROM (SELECT DISTINCT hour, iy AS iy0, ix AS ix0 FROM loc) AS c, (SELECT unnest(range(-10, 11)) AS dy) AS a, (SELECT unnest(range(-10, 11)) AS dx) AS b
WHERE iy0 + dy BETWEEN -360 AND 360"""
CTES["spots"] = "SELECT DISTINCT hour, iy, ix FROM around"
CTES["field0"] = """
SELECT hour, iy, ix, CAST(((epoch_us(hour) // 3600000000) * 7 + iy * 13 + ix * 29 + 1009000) % 1009 AS DOUBLE) AS a FROM spots"""
CTES["lev"] = """
SELECT hour, iy, ix, a, i, (i * 950.0 + a % 50) * CAST(9.81 AS DOUBLE) / CAST(9.81 AS DOUBLE) AS h, i * 2.5 + a % 9 AS u, 12.0 - i * 1.25 + a % 5 AS v
FROM field0, (SELECT unnest(range(1, 9)) AS i) AS l WHERE (a + i) % 97 <> 5"""


def _shear_sql(height: int) -> str:
    return f"""SELECT hour, iy, ix, CASE WHEN n >= 2 THEN sqrt(power(lo.u + ({height} - lo.h) * coalesce((hi.u - lo.u) / nullif(hi.h - lo.h, 0), 0) - a % 4, 2)
      + power(lo.v + ({height} - lo.h) * coalesce((hi.v - lo.v) / nullif(hi.h - lo.h, 0), 0) - a % 6, 2)) END AS shear_{height}m
      FROM (SELECT hour, iy, ix, any_value(a) AS a, count(*) AS n, max(struct_pack(h := h, u := u, v := v)) FILTER (WHERE h <= {height}) AS lo,
            min(struct_pack(h := h, u := u, v := v)) FILTER (WHERE h >= {height}) AS hi FROM lev GROUP BY 1, 2, 3) AS s"""


CTES["fields"] = f"""
SELECT f.hour, f.iy, f.ix, a * 4 AS cape, CASE WHEN a % 7 <> 3 THEN -a / 8 END AS cin, CASE WHEN a % 3 <> 1 THEN 290.0 + a / 64 END AS sst,
       280.0 + a / 32 AS skt, a / 1000 AS tpr, shear_1000m, shear_3000m, shear_6000m FROM field0 f
LEFT JOIN ({_shear_sql(1000)}) AS s1 USING (hour, iy, ix) LEFT JOIN ({_shear_sql(3000)}) AS s3 USING (hour, iy, ix) LEFT JOIN ({_shear_sql(6000)}) AS s6 USING (hour, iy, ix)"""
register(
    "E1_shear",
    lambda t: cells(t).join(growing(environment.box_cells(environment.locate(t.swath_features)).select("hour", "iy", "ix").distinct()), ["hour", "iy", "ix"]),
    "SELECT epoch_us(hour) AS hour, iy, ix, cape, cin, sst, skt, tpr, shear_1000m, shear_3000m, shear_6000m FROM fields",
    doubles="cape cin sst skt tpr shear_1000m shear_3000m shear_6000m",
    longs="hour iy ix",
)
register(
    "E2_J6_J7_centroid_values",
    lambda t: environment.centroid_values(t.swath_features, cells(t)).select("feature_id", *[f"{v}_centroid" for v in _VARS]),
    f"""SELECT CASE mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + orbit * 100000 + local_label AS feature_id,
        {', '.join(f'{v} AS {v}_centroid' for v in _VARS)} FROM loc LEFT JOIN fields USING (hour, iy, ix)""",
    doubles=" ".join(f"{v}_centroid" for v in _VARS),
    longs="feature_id",
)
_BOXSQL = []
for _v in _VARS:
    for _b, _r in C.ENV_BOXES.items():
        _f = f"FILTER (WHERE ring <= {_r})"
        _BOXSQL += [f"{fn}({_v}) {_f} AS {s}_{_v}_{_b}" for s, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))]
        _BOXSQL += [f"quantile_cont({_v}, {p / 100}) {_f} AS p{p}_{_v}_{_b}" for p in C.ENV_PERCENTILES]
_BOXCOLS = [c for c in schemas.env_columns() if not c.endswith("_centroid")]
register(
    "E3_E4_J8_box_statistics",
    lambda t: environment.box_stats(t.swath_features, cells(t)).select("feature_id", *_BOXCOLS),
    f"""SELECT CASE mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + orbit * 100000 + local_label AS feature_id, b.* EXCLUDE (hour, iy0, ix0)
        FROM loc l JOIN (SELECT hour, iy0, ix0, {', '.join(_BOXSQL)} FROM around JOIN fields USING (hour, iy, ix) GROUP BY 1, 2, 3) b
        ON b.hour = l.hour AND b.iy0 = l.iy AND b.ix0 = l.ix""",
    doubles=" ".join(_BOXCOLS),
    longs="feature_id",
    digits=9,
)
register(
    "E6_environment_table",
    lambda t: environment.env_for_features(t.swath_features, reanalysis(t)).groupBy("mission", "orbit").agg(
        F.count("*").alias("n"), F.sum("cape_centroid").cast("double").alias("cape"), F.sum(F.col("p90_cape_2p50deg").cast("double")).alias("p90"),
        F.count("mean_cin_5deg").alias("n_cin")),
    """SELECT mission, orbit, count(*) AS n, sum(cape) AS cape, sum(p90) AS p90, count(mean_cin) AS n_cin FROM (
       SELECT l.mission, l.orbit, CAST(f.cape AS DOUBLE) AS cape, CAST(CAST(b.p90 AS FLOAT) AS DOUBLE) AS p90, b.mean_cin FROM loc l LEFT JOIN fields f USING (hour, iy, ix)
       LEFT JOIN (SELECT hour, iy0, ix0, quantile_cont(cape, 0.9) FILTER (WHERE ring <= 5) AS p90, avg(cin) AS mean_cin FROM around JOIN fields USING (hour, iy, ix) GROUP BY 1, 2, 3) b
       ON b.hour = l.hour AND b.iy0 = l.iy AND b.ix0 = l.ix) AS z GROUP BY 1, 2""",
    doubles="cape p90",
    longs="orbit n n_cin",
    digits=1,
)


def env_sql(keys: str) -> str:
    """All value columns of the environment table by feature."""
    from rainloom import constants as C

    centre = ", ".join(f"f.{v} AS {v}_centroid" for v in C.ENV_VARS)
    return f"""SELECT {keys}, CASE mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + orbit * 100000 + local_label AS feature_id, {centre}, {", ".join(f"b.{c}" for c in _BOXCOLS)}
        FROM loc l LEFT JOIN fields f ON f.hour = l.hour AND f.iy = l.iy AND f.ix = l.ix
        LEFT JOIN (SELECT hour, iy0, ix0, {', '.join(_BOXSQL)} FROM around JOIN fields USING (hour, iy, ix) GROUP BY 1, 2, 3) b
        ON b.hour = l.hour AND b.iy0 = l.iy AND b.ix0 = l.ix"""
