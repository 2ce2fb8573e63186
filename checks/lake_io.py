"""Sources, sinks, inventory, validation, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import CTES, latbin, lonbin, register
from checks.grids import DEG, month_grids, obs_grids, staged_grids
from checks.pixels import env_sql
from rainloom import schemas
from rainloom.functions import scalars as S
from rainloom.operators import validate
from rainloom.operators.gridding import orbit_views
from rainloom.session import materialize, shared_folder
from rainloom.sources import granules as gr
from rainloom.sources import lake
from rainloom.streaming.hourly import hourly_grid, merged_grid, open_hours, stream_hourly_grid, stream_merged_grid

FK = "mission, orbit, local_label"
JOINT = ["lat_bin", "lon_bin", "hour", "size_class", "echotop_class", "raintype"]


def new_root(t, label: str) -> str:
    return f"{shared_folder(t.spark)}/rainloom/{label}-{uuid.uuid4().hex}"


def lake_root(t) -> str:
    """A landing tree with the swath's features, pixels and views."""
    if not hasattr(t, "_lake"):
        root = new_root(t, "lake")
        lake.write_features(t.swath_features, root)
        from rainloom.operators.features import build_pixels

        lake.write_pixels(build_pixels(t.flat, t.labels, t.members), t.swath_features, root)
        lake.write_views(orbit_views(t.flat), root)
        t._lake = root
    return t._lake


CTES["feat"] = f"""
SELECT CASE mission WHEN 'GPM' THEN 2 ELSE 1 END * 10000000000000 + orbit * 100000 + local_label AS feature_id, {FK},
       make_timestamp(CAST(sum(CAST(epoch_us(time) AS HUGEINT)) // count(*) AS BIGINT)) AS time, count(*) AS npixels FROM mem GROUP BY {FK}"""
CTES["orbit_month"] = """
SELECT mission, orbit, year(m) AS year, month(m) AS month FROM (
  SELECT mission, orbit, make_timestamp(CAST(sum(CAST(epoch_us(time) AS HUGEINT)) // count(*) AS BIGINT)) AS m FROM feat GROUP BY 1, 2) AS o"""

register(
    "IO1_read_months",
    lambda t: lake.read_table(t.spark, lake_root(t), "features", "GPM", [1, 12]).groupBy("mission", "orbit", "year", "month", "granule").agg(F.sum("npixels").alias("px")),
    """SELECT f.mission, f.orbit, year, month, lpad(CAST(f.orbit AS VARCHAR), 6, '0') AS granule, sum(npixels) AS px FROM feat f JOIN orbit_month o
       ON o.mission = f.mission AND o.orbit = f.orbit WHERE f.mission = 'GPM' AND month IN (1, 12) GROUP BY ALL""",
    longs="orbit year month px",
)
register(
    "IO2_scan_window",
    lambda t: lake.scan_features(t.features, "trmm", "1997-02-01", "1998-02-01", ["feature_id", "centroid_lat"]),
    "SELECT feature_id, centroid_lat FROM cat WHERE mission = 'TRMM' AND time >= TIMESTAMP '1997-02-01' AND time < TIMESTAMP '1998-02-01'",
    doubles="centroid_lat",
    longs="feature_id",
)
register(
    "IO3_orbits_starting",
    lambda t: lake.features_for_orbits_starting(t.swath_features, "2024-01-11", "2024-01-21").select("feature_id"),
    """SELECT feature_id FROM (SELECT *, min(time) OVER (PARTITION BY mission, orbit) AS start FROM feat
       WHERE time >= TIMESTAMP '2024-01-11' - INTERVAL 2 HOUR AND time < TIMESTAMP '2024-01-21' + INTERVAL 2 HOUR) AS s
       WHERE start >= TIMESTAMP '2024-01-11' AND start < TIMESTAMP '2024-01-21'""",
    longs="feature_id",
)
register(
    "IO2_window_of_the_lake",
    # only the folders of the months around the window are read
    lambda t: lake.scan_features(lake.read_table(t.spark, lake_root(t), "features"), "gpm", "2024-01-05", "2024-02-20", ["feature_id", "orbit", "npixels"]).unionByName(
        lake.scan_features(lake.read_months(t.spark, lake_root(t), "features", "trmm", "2024-01-05", "2024-02-20"), "trmm", "2024-01-05", "2024-02-20", ["feature_id", "orbit", "npixels"])),
    "SELECT feature_id, orbit, npixels FROM feat WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-02-20'",
    longs="feature_id orbit npixels",
)
register(
    "IO3_orbits_of_the_lake",
    lambda t: lake.features_for_orbits_starting(lake.read_table(t.spark, lake_root(t), "features"), "2024-01-11", "2024-01-21").select("feature_id", "year", "month"),
    """SELECT feature_id, year, month FROM (SELECT *, min(time) OVER (PARTITION BY mission, orbit) AS start FROM feat
       WHERE time >= TIMESTAMP '2024-01-11' - INTERVAL 2 HOUR AND time < TIMESTAMP '2024-01-21' + INTERVAL 2 HOUR) AS s JOIN orbit_month USING (mission, orbit)
       WHERE start >= TIMESTAMP '2024-01-11' AND start < TIMESTAMP '2024-01-21'""",
    longs="feature_id year month",
)


def _rewrite(t):
    """Write all orbits, one of them 40 days late, then this one again: it is found once, in its own month."""
    root = new_root(t, "rewrite")
    late = F.when(F.col("orbit") == 1, F.col("time") + F.expr("INTERVAL 40 DAY")).otherwise(F.col("time"))
    lake.write_features(t.swath_features.withColumn("time", late), root)
    lake.write_features(t.swath_features.where("orbit = 1"), root)
    return lake.read_table(t.spark, root, "features").select("mission", "orbit", "local_label", "feature_id", "npixels", "time", "year", "month")


register(
    "IO4_write_features_twice",
    _rewrite,
    "SELECT mission, orbit, local_label, feature_id, npixels, epoch_us(time) AS time, year, month FROM feat JOIN orbit_month USING (mission, orbit)",
    longs="orbit local_label feature_id npixels time year month",
)
register(
    "IO4_orbit_index",
    lambda t: lake.orbit_index(t.spark, lake_root(t), "pixels").select("mission", "granule", "year", "month", "n_rows"),
    """SELECT mission, lpad(CAST(orbit AS VARCHAR), 6, '0') AS granule, year, month, count(*) AS n_rows FROM lab JOIN orbit_month USING (mission, orbit) GROUP BY ALL""",
    longs="year month n_rows",
)
register(
    "IO4_write_pixels",
    lambda t: lake.read_table(t.spark, lake_root(t), "pixels").select("mission", "orbit", "year", "month", "scan", "ray", "lat", "near_sfc_rain", "near_sfc_dbz", "rain_type"),
    """SELECT mission, orbit, year, month, scan, ray, lat, near_sfc_rain, near_sfc_dbz, rain_type FROM mem JOIN orbit_month USING (mission, orbit)""",
    doubles="lat near_sfc_rain near_sfc_dbz",
    longs="orbit year month scan ray rain_type",
)
register(
    "IO5_write_views",
    lambda t: lake.read_table(t.spark, lake_root(t), "views").select("mission", "orbit", "lat_bin", "lon_bin", "n_views"),
    f"""SELECT mission, orbit, {latbin('lat', 0.05)} AS lat_bin, {lonbin('lon', 0.05)} AS lon_bin, count(*) AS n_views
        FROM px WHERE near_sfc_rain IS NOT NULL GROUP BY ALL""",
    longs="orbit lat_bin lon_bin n_views",
)


def _env_round_trip(t):
    from checks.pixels import reanalysis
    from rainloom.operators.environment import env_for_features

    root = new_root(t, "env")
    lake.write_env(env_for_features(t.swath_features, reanalysis(t)), root, t.swath_features)
    return lake.read_table(t.spark, root, "era5").select("mission", "orbit", "feature_id", *schemas.env_columns())


register(
    "IO6_write_environment",
    _env_round_trip,
    env_sql("mission, orbit"),
    doubles=" ".join(schemas.env_columns()),
    longs="orbit feature_id",
    digits=1,
    single=True,
)


def _env_job(t):
    """Environment of the orbits that start in a window, from a root with stored features."""
    from checks.pixels import reanalysis
    from rainloom.plans.jobs import run_env

    root = new_root(t, "env-job")
    lake.write_features(t.swath_features, root)
    run_env(t.spark, root, reanalysis(t), "2024-01-11", "2024-01-21")
    return lake.read_table(t.spark, root, "era5").select("mission", "orbit", "feature_id", "cape_centroid", "mean_cape_5deg", "p90_cape_2p50deg")


register(
    "E6_environment_job",
    _env_job,
    f"""SELECT mission, orbit, feature_id, cape_centroid, mean_cape_5deg, p90_cape_2p50deg FROM ({env_sql("mission, orbit")}) AS e WHERE feature_id IN (
       SELECT feature_id FROM (SELECT *, min(time) OVER (PARTITION BY mission, orbit) AS start FROM feat
       WHERE time >= TIMESTAMP '2024-01-11' - INTERVAL 2 HOUR AND time < TIMESTAMP '2024-01-21' + INTERVAL 2 HOUR) AS s
       WHERE start >= TIMESTAMP '2024-01-11' AND start < TIMESTAMP '2024-01-21')""",
    doubles="cape_centroid mean_cape_5deg p90_cape_2p50deg",
    longs="orbit feature_id",
    digits=1,
    single=True,
)


def _grid_round_trip(t):
    root = new_root(t, "grids")
    for name, df in staged_grids(t).items():
        lake.write_grid(df, root, name)
    lake.write_grid(staged_grids(t)["rain"].limit(0), root + "-empty", "rain")
    rain = lake.read_table(t.spark, root, "grid_rain", granule=False).groupBy("mission", "year", "month").agg(
        F.count("*").alias("rows"), F.sum("rain_sum").alias("rain_sum")
    )
    empty = lake.read_table(t.spark, root + "-empty", "grid_rain", granule=False).select("mission", "year", "month", F.lit(0).alias("rows"), "rain_sum")
    return rain.unionByName(empty)


register(
    "IO7_IO10_write_grids",
    _grid_round_trip,
    "SELECT mission, year, month, count(*) AS rows, sum(rain_sum) AS rain_sum FROM swath_rain GROUP BY 1, 2, 3",
    doubles="rain_sum",
    longs="year month rows",
    digits=4,
)


def _twice(t):
    """Every month is run, then run again with the rain of one mission only: the others are dry now, and the report has each once."""
    root = new_root(t, "twice")
    rain = staged_grids(t)["rain"]
    months = materialize(rain.select(*lake.MONTH).distinct(), "months")
    for part in (rain, rain.where("mission = 'TRMM'")):
        lake.write_grid(part, root, "rain", months)
        stored = lake.read_table(t.spark, root, "grid_rain", granule=False).groupBy(*lake.MONTH).agg(F.count("*").alias("n_rain"), F.sum("rain_sum").alias("rain_sum"))
        lake.write_report(months.join(stored, lake.MONTH, "left").fillna(0), root)
    return t.spark.read.parquet(f"{root}/processed_months").select(*lake.MONTH, "n_rain", "rain_sum")


register(
    "IO7_G18_month_run_twice",
    _twice,
    """SELECT mission, year, month, CASE mission WHEN 'TRMM' THEN count(*) ELSE 0 END AS n_rain, CASE mission WHEN 'TRMM' THEN sum(rain_sum) ELSE 0 END AS rain_sum
       FROM swath_rain GROUP BY 1, 2, 3""",
    doubles="rain_sum",
    longs="year month n_rain",
    digits=4,
)


def _joint(t):
    path = new_root(t, "joint")
    for months in ("month <= 6", "month > 6"):  # the second half leaves the first as it is
        lake.write_joint(obs_grids(t)[0].where(months), path)
    return t.spark.read.parquet(path).select("mission", "month", *JOINT, "rain_sum", "raining_count")


register(
    "IO8_sparse_joint",
    _joint,
    f"SELECT mission, month, {', '.join(JOINT)}, rain_sum, raining_count FROM obs_rain",
    doubles="rain_sum",
    longs="month " + " ".join(JOINT) + " raining_count",
)


def _compacted(t):
    dst = new_root(t, "compact")
    first = lake.compact(t.spark, lake_root(t), dst, "pixels").withColumn("pass", F.lit(1))
    second = lake.compact(t.spark, lake_root(t), dst, "pixels").withColumn("pass", F.lit(2))
    return first.unionByName(second)


register(
    "IO9_V5_compaction",
    _compacted,
    """SELECT mission, year, month, n AS source_rows, n AS target_rows, unnest(['ok', 'skip']) AS status, unnest([1, 2]) AS pass FROM (
       SELECT l.mission, year, month, count(*) AS n FROM lab l JOIN orbit_month o ON o.mission = l.mission AND o.orbit = l.orbit GROUP BY ALL) AS c""",
    longs="year month source_rows target_rows pass",
)


def _changed(t):
    """An orbit is written again with as many rows, another one moves by 40 days: the second compaction finds both."""
    src, dst = new_root(t, "changing"), new_root(t, "changed")
    lake.write_features(t.swath_features, src)
    lake.compact(t.spark, src, dst, "features")
    later = F.when(F.col("orbit") == 2, F.col("time") + F.expr("INTERVAL 40 DAY")).otherwise(F.col("time"))
    again = t.swath_features.where("orbit IN (1, 2)").withColumns({"npixels": F.col("npixels") + F.when(F.col("orbit") == 1, 1000).otherwise(0), "time": later})
    lake.write_features(again, src)
    lake.compact(t.spark, src, dst, "features")
    return lake.read_table(t.spark, dst, "features", granule=False).select("mission", "orbit", "local_label", "npixels", "time", "year", "month")


register(
    "IO9_changed_contents",
    _changed,
    """SELECT mission, orbit, local_label, npixels + CASE orbit WHEN 1 THEN 1000 ELSE 0 END AS npixels, epoch_us(moved) AS time, year(m) AS year, month(m) AS month FROM (
       SELECT *, make_timestamp(CAST(sum(CAST(epoch_us(moved) AS HUGEINT)) OVER (PARTITION BY mission, orbit) // count(*) OVER (PARTITION BY mission, orbit) AS BIGINT)) AS m
       FROM (SELECT *, CASE orbit WHEN 2 THEN time + INTERVAL 40 DAY ELSE time END AS moved FROM feat) AS f) AS g""",
    longs="orbit local_label npixels time year month",
)
register(
    "V5_U6_contents",
    # equal counts everywhere; the values of one ray differ
    lambda t: validate.reconcile_tables(
        t.pixels.select("mission", "scan", "ray", "feature_id", "near_sfc_rain"),
        t.pixels.select("mission", "scan", "ray", "feature_id", F.when(F.col("ray") == 7, -1.0).otherwise(F.col("near_sfc_rain")).cast("double").alias("near_sfc_rain")).repartition(5),
        ("mission", "ray")).select("mission", "ray", "source_rows", "target_rows", "status"),
    "SELECT mission, ray, count(*) AS source_rows, count(*) AS target_rows, CASE ray WHEN 7 THEN 'mismatch' ELSE 'ok' END AS status FROM pix GROUP BY 1, 2",
    longs="ray source_rows target_rows",
)
register(
    "IO10_missing_table",
    lambda t: lake.read_table(t.spark, new_root(t, "nowhere"), "features").unionByName(lake.read_table(t.spark, lake_root(t), "features")).select("mission", "orbit", "local_label", "npixels", "granule"),
    "SELECT mission, orbit, local_label, npixels, lpad(CAST(orbit AS VARCHAR), 6, '0') AS granule FROM feat",
    longs="orbit local_label npixels",
)

# --- granules -------------------------------------------------------------


def names(t):
    """File names of a granule archive, one or two per order."""
    k = F.col("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    sec = F.pmod(k * 379, F.lit(86400))

    def hms(s):
        s = F.pmod(s, F.lit(86400))
        return F.concat(
            F.lpad(S.int_div(s, 3600).cast("string"), 2, "0"),
            F.lpad(S.int_div(F.pmod(s, F.lit(3600)), 60).cast("string"), 2, "0"),
            F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"),
        )

    version = F.when(F.pmod(k, F.lit(4)) == 0, F.lit("V08B")).otherwise(F.lit("V07A"))
    end = F.when(F.pmod(k, F.lit(9)) == 0, F.lit("")).otherwise(F.concat(F.lit("-E"), hms(sec + 5544)))
    orbit = F.lpad(F.pmod(k, F.lit(7000)).cast("string"), 6, "0")
    name = F.concat(F.lit("/archive/2A.GPM.Ku.V9-20220125."), day, F.lit("-S"), hms(sec), end, F.lit("."), orbit, F.lit("."), version, F.lit(".HDF5"))
    broken = F.concat(F.lit("notes-"), k.cast("string"), F.lit(".txt"))
    return t.table("orders").select(
        k.alias("seq"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(3)) == 0, F.lit("TRMM")).otherwise(F.lit("GPM")).alias("mission"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(3)) == 0, F.lit("GPM_2APR"))
        .when(F.pmod(F.col("o_custkey"), F.lit(3)) == 1, F.lit("GPM_2AKu")).otherwise(F.lit("GPM_1CGPMGMI")).alias("product"),
        F.when(F.pmod(k, F.lit(50)) == 7, broken).otherwise(name).alias("name"),
    )


_HMS = "lpad(CAST(({0} % 86400) // 3600 AS VARCHAR), 2, '0') || lpad(CAST(({0} % 3600) // 60 AS VARCHAR), 2, '0') || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
CTES["gname"] = f"""
SELECT seq, mission, product, day, sec, CASE WHEN seq % 50 = 7 THEN 'notes-' || seq || '.txt' ELSE '/archive/2A.GPM.Ku.V9-20220125.' || strftime(day, '%Y%m%d') || '-S' || {_HMS.format('sec')}
  || CASE WHEN seq % 9 = 0 THEN '' ELSE '-E' || {_HMS.format('(sec + 5544)')} END || '.' || lpad(CAST(seq % 7000 AS VARCHAR), 6, '0') || '.' ||
  CASE WHEN seq % 4 = 0 THEN 'V08B' ELSE 'V07A' END || '.HDF5' END AS name
FROM (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 3 = 0 THEN 'TRMM' ELSE 'GPM' END AS mission,
  CASE o_custkey % 3 WHEN 0 THEN 'GPM_2APR' WHEN 1 THEN 'GPM_2AKu' ELSE 'GPM_1CGPMGMI' END AS product, CAST(o_orderdate AS TIMESTAMP) AS day, (o_orderkey * 379) % 86400 AS sec FROM orders) AS o"""
CTES["gran"] = """
SELECT seq, mission, product, name, CASE WHEN seq % 50 <> 7 THEN seq % 7000 END AS orbit, CASE WHEN seq % 50 <> 7 THEN CASE WHEN seq % 4 = 0 THEN '08B' ELSE '07A' END END AS version,
  CASE WHEN seq % 50 <> 7 THEN day + to_seconds(sec) END AS obs_start,
  CASE WHEN seq % 50 <> 7 THEN day + to_seconds(sec + CASE WHEN seq % 9 = 0 THEN 6000 ELSE 5544 END) END AS obs_end FROM gname"""


def parsed(t):
    """Names are stored first, as an archive's listing is."""
    if not hasattr(t, "_names"):
        t._names = materialize(names(t), "names")
    return gr.parse_granules(t._names)


register(
    "IO11_parse_granules",
    lambda t: parsed(t).select("seq", F.col("orbit").cast("double").alias("orbit"), "version", *[F.unix_micros(c).cast("double").alias(c) for c in ("obs_start", "obs_end")]),
    "SELECT seq, orbit, version, epoch_us(obs_start) AS obs_start, epoch_us(obs_end) AS obs_end FROM gran",
    doubles="orbit obs_start obs_end",
    longs="seq",
    digits=0,
)
register(
    "IO12_prefer_version",
    lambda t: gr.prefer_version(parsed(t)).select("seq"),
    """SELECT seq FROM (SELECT seq, hit, bool_or(hit) OVER (PARTITION BY product, mission, orbit) AS any_hit FROM (
       SELECT *, contains(name, CASE product WHEN 'GPM_1CGPMGMI' THEN '.V08' ELSE '.V07' END) AS hit FROM gran) AS h) AS g WHERE hit OR NOT any_hit""",
    longs="seq",
)
register(
    "IO12_prefer_version_of_run",
    lambda t: gr.prefer_version(parsed(t).where("product <> 'GPM_1CGPMGMI' OR version = '07A'"), by=()).select("seq", "product", "version"),
    "SELECT seq, product, version FROM gran WHERE version = '07A'",
    longs="seq",
)
register(
    "IO13_one_per_orbit",
    lambda t: gr.one_per_orbit(parsed(t)).select("mission", "orbit", "seq"),
    "SELECT mission, orbit, max(seq) AS seq FROM gran WHERE orbit IS NOT NULL GROUP BY 1, 2",
    longs="orbit seq",
)
register(
    "IO14_pair_granules",
    lambda t: gr.pair_granules(
        gr.one_per_orbit(parsed(t).where("product = 'GPM_2AKu'")), gr.one_per_orbit(parsed(t).where("product = 'GPM_1CGPMGMI'"))
    ).select("orbit", "radar_name", "imager_name"),
    """SELECT r.orbit, r.name AS radar_name, i.name AS imager_name FROM (SELECT orbit, arg_max(name, seq) AS name FROM gran WHERE product = 'GPM_2AKu' AND orbit IS NOT NULL GROUP BY 1) r
       LEFT JOIN (SELECT orbit, arg_max(name, seq) AS name FROM gran WHERE product = 'GPM_1CGPMGMI' AND orbit IS NOT NULL GROUP BY 1) i USING (orbit)""",
    longs="orbit",
)
register(
    "IO15_orbits_of_days",
    lambda t: gr.orbits_starting_in(parsed(t), "1996-05-01", "1996-12-31").select("seq"),
    "SELECT seq FROM gran WHERE obs_start IS NULL OR (obs_start >= TIMESTAMP '1996-05-01' AND obs_start < TIMESTAMP '1997-01-01')",
    longs="seq",
)
register(
    "J9_granule_months",
    lambda t: gr.granule_months(parsed(t)).select("seq", F.col("year").cast("double").alias("year"), F.col("month").cast("double").alias("month")),
    """SELECT seq, year(m) AS year, month(m) AS month FROM (SELECT seq, unnest(generate_series(date_trunc('month', obs_start), date_trunc('month', obs_end - INTERVAL 1 MICROSECOND), INTERVAL 1 MONTH)) AS m
       FROM gran WHERE obs_start IS NOT NULL) AS g
       UNION ALL SELECT seq, year(m), month(m) FROM (SELECT seq FROM gran WHERE obs_start IS NULL) AS u, (SELECT unnest(generate_series(date_trunc('month', min(obs_start)), date_trunc('month', max(obs_end - INTERVAL 1 MICROSECOND)), INTERVAL 1 MONTH)) AS m FROM gran) AS r""",
    doubles="year month",
    longs="seq",
)
register(
    "IO16_run_report",
    lambda t: lake.run_report(
        t.flat.groupBy("mission", "orbit").agg((F.max("orbit") % 3 != 2).alias("has_radar")),
        # what belongs to orbit 1 was stored under another number, and so were the views of orbit 4
        *[df.withColumn("orbit", F.when(F.col("orbit") == 1, 1001).otherwise(F.col("orbit"))) for df in (t.swath_features, t.members)],
        orbit_views(t.flat).withColumn("orbit", F.when(F.col("orbit") == 4, 1004).otherwise(F.col("orbit"))),
    ).select("mission", "orbit", "n_features", "n_pixels", "n_views", "status"),
    f"""SELECT mission, orbit, coalesce(f.n, 0) AS n_features, coalesce(p.n, 0) AS n_pixels, coalesce(v.n, 0) AS n_views,
        CASE WHEN known AND orbit % 3 = 2 THEN 'skipped_no_radar' WHEN f.n > 0 THEN 'ok' WHEN v.n > 0 THEN 'empty' ELSE 'failed' END AS status
        FROM (SELECT DISTINCT mission, orbit, true AS known FROM px) o
        FULL JOIN (SELECT mission, CASE orbit WHEN 1 THEN 1001 ELSE orbit END AS orbit, count(*) AS n FROM feat GROUP BY 1, 2) f USING (mission, orbit)
        FULL JOIN (SELECT mission, CASE orbit WHEN 1 THEN 1001 ELSE orbit END AS orbit, count(*) AS n FROM lab GROUP BY 1, 2) p USING (mission, orbit)
        FULL JOIN (SELECT mission, CASE orbit WHEN 4 THEN 1004 ELSE orbit END AS orbit, count(DISTINCT ({latbin('lat', 0.05)}) * 7200 + {lonbin('lon', 0.05)}) AS n FROM px WHERE near_sfc_rain IS NOT NULL GROUP BY 1, 2) v USING (mission, orbit)""",
    longs="orbit n_features n_pixels n_views",
)

# --- validation -----------------------------------------------------------

register(
    "J10_integrity",
    lambda t: validate.integrity_violations(t.pixels, t.features).select(
        "feature_id", "problem", F.col("found").cast("double").alias("found"), F.col("expected").cast("double").alias("expected")),
    """SELECT feature_id, CASE WHEN npixels IS NULL THEN 'pixels without feature' WHEN n IS NULL THEN 'feature without pixels' ELSE 'count differs' END AS problem, n AS found, npixels AS expected
       FROM (SELECT feature_id, count(*) AS n FROM pix GROUP BY 1) p FULL JOIN (SELECT feature_id, npixels FROM cat) f USING (feature_id) WHERE n IS DISTINCT FROM npixels""",
    doubles="found expected",
    longs="feature_id",
)
register(
    "J10_orphan_pixels",
    lambda t: validate.orphan_pixels(t.pixels, t.features.where("area_km2 > 100")).select("feature_id", "scan", "ray"),
    "SELECT feature_id, scan, ray FROM pix WHERE feature_id NOT IN (SELECT feature_id FROM cat WHERE area_km2 > 100)",
    longs="feature_id scan ray",
)
register(
    "J10_swath_tables_agree",
    lambda t: t.swath_features.groupBy("mission").agg(F.count("*").alias("n")).join(
        validate.integrity_violations(lake.read_table(t.spark, lake_root(t), "pixels"), lake.read_table(t.spark, lake_root(t), "features"))
        .groupBy(S.decode_feature_id("feature_id")["mission"].alias("mission")).agg(F.count("*").alias("violations")),
        "mission", "left").fillna(0, ["violations"]),
    "SELECT mission, count(*) AS n, 0 AS violations FROM feat GROUP BY 1",
    longs="n violations",
)
register(
    "V1_schema",
    # a table of the lake under its own footer's schema, with one column renamed and one widened
    lambda t: validate.check_schema(
        lake.read_table(t.spark, lake_root(t), "features").drop("year", "month", "granule").withColumnRenamed("edge", "at_edge").withColumn("orbit", F.col("orbit").cast("long")), schemas.FEATURES),
    """SELECT * FROM (VALUES (2, 'orbit', 'bigint', 'unexpected'), (43, 'at_edge', 'boolean', 'unexpected'), (2, 'orbit', 'int', 'missing'), (43, 'edge', 'boolean', 'missing')) AS v(position, name, type, problem)
       WHERE (SELECT count(*) FROM events) > 0""",
    longs="position",
)
register(
    "V2_conservation",
    lambda t: validate.check_conservation(
        t.flat, month_grids(t)["views"].where("mission = 'GPM' OR lat_bin % 2 = 0").groupBy("mission", "lat_bin", "lon_bin", "hour").agg(F.sum("n_views").alias("n_views")),
        staged_grids(t)["rain"]).groupBy("mission", "problem").agg(F.count("*").alias("n")),
    """SELECT 'TRMM' AS mission, 'total' AS problem, 1 AS n FROM (SELECT count(*) AS c FROM swath_views WHERE mission = 'TRMM' AND lat_bin % 2 = 1) AS t WHERE c > 0
       UNION ALL SELECT 'TRMM', 'rain without view', count(*) FROM (SELECT DISTINCT lat_bin, lon_bin, hour FROM swath_rain WHERE mission = 'TRMM' AND lat_bin % 2 = 1) AS r HAVING count(*) > 0""",
    longs="n",
)
register(
    "V3_ranges",
    lambda t: validate.check_ranges(
        t.features.withColumns({"centroid_lat": F.col("centroid_lat") * 2.4, "local_label": F.when(F.col("npixels") == 5, 1).otherwise(F.col("local_label"))}), 2.0),
    """SELECT feature_id, unnest(list_filter([CASE WHEN abs(centroid_lat * CAST(2.4 AS DOUBLE)) > 90 THEN 'latitude' END, CASE WHEN area_km2 < 2 THEN 'area' END,
       CASE WHEN npixels = 5 AND local_label <> 1 THEN 'round trip' END, CASE WHEN npixels = 5 AND local_label <> 1 THEN 'decoded' END], lambda p: p IS NOT NULL)) AS problem FROM cat""",
    longs="feature_id",
)


def _fields(t):
    from checks.grids import fields
    from rainloom.plans.climatology import MEMBERS, QUANTITIES, long_fields

    """Frequencies with the wrong sign, and one field that has no value left."""
    bad = long_fields(fields(t)).withColumn("value", F.when(F.col("quantity") == "freq", -F.col("value")).otherwise(F.col("value")))
    bad = bad.where("quantity <> 'intensity'")
    expected = [(m, q) for m in MEMBERS for q in QUANTITIES]
    found = validate.check_fields(bad, ("member", "quantity"), "value", expected).select("member", "quantity", "problem", "n_values")
    return found.where("problem <> 'empty' OR quantity = 'intensity'")


register(
    "V4_published_fields",
    _fields,
    """SELECT member, quantity, 'negative' AS problem, count(*) AS n_values FROM sw_long WHERE quantity = 'freq' GROUP BY 1, 2 HAVING max(value) > 0
       UNION ALL SELECT DISTINCT member, 'intensity', 'empty', 0 FROM sw_fields""",
    longs="n_values",
)

# --- streaming ------------------------------------------------------------


def _streamed(t):
    """Every orbit arrives, then one arrives again in another file; open hours are added from the input."""
    root = new_root(t, "stream")
    t.flat.write.parquet(f"{root}/in")
    t.flat.where("orbit = 1").write.mode("append").parquet(f"{root}/in")
    stream_hourly_grid(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", "1 day", DEG, True).awaitTermination()
    written = t.spark.read.schema(hourly_grid(t.flat, deg=DEG).schema).parquet(f"{root}/out")
    return written.unionByName(open_hours(t.spark, f"{root}/in", f"{root}/out", DEG))


CTES["hourly"] = f"""
SELECT date_trunc('hour', time) AS hour_start, mission, {latbin('lat', DEG)} AS lat_bin, {lonbin('lon', DEG)} AS lon_bin, count(*) AS n_views, """ + ", ".join(
    f"coalesce(sum(near_sfc_rain) FILTER (WHERE near_sfc_rain > 0 AND rain_type = {i}), 0) AS {n}_sum, count(*) FILTER (WHERE near_sfc_rain > 0 AND rain_type = {i}) AS {n}_count"
    for i, n in ((1, "stratiform"), (2, "convective"), (3, "other"))
) + " FROM px WHERE near_sfc_rain IS NOT NULL GROUP BY 1, 2, 3, 4"
register(
    "T1_hourly_stream",
    _streamed,
    "SELECT * REPLACE (epoch_us(hour_start) AS hour_start) FROM hourly",
    doubles="stratiform_sum convective_sum other_sum",
    longs="hour_start lat_bin lon_bin n_views stratiform_count convective_count other_count",
)


def _merged(t):
    """The latest orbits arrive first; then the earliest, days too late, and some again: every hour is right, without open ones."""
    root = new_root(t, "merged")
    for part in ("orbit > 2", "orbit <= 2", "orbit IN (1, 3)"):
        t.flat.where(part).write.mode("append").parquet(f"{root}/in")
        stream_merged_grid(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", DEG, True).awaitTermination()
    return merged_grid(t.spark, f"{root}/out", DEG)


register(
    "T1_late_and_repeated",
    _merged,
    "SELECT * REPLACE (epoch_us(hour_start) AS hour_start) FROM hourly",
    doubles="stratiform_sum convective_sum other_sum",
    longs="hour_start lat_bin lon_bin n_views stratiform_count convective_count other_count",
)
register(
    "T1_hourly_batch",
    lambda t: hourly_grid(t.flat, deg=DEG),
    "SELECT * REPLACE (epoch_us(hour_start) AS hour_start) FROM hourly",
    doubles="stratiform_sum convective_sum other_sum",
    longs="hour_start lat_bin lon_bin n_views stratiform_count convective_count other_count",
)
