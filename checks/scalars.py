"""Column operators (decoding, classes, predicates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import POP, echo_case, hav, latbin, lonbin, register, size_case
from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.operators import validate
from rainloom.plans.catalogue import in_regions
from rainloom.testbed import cents

_E = "(SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS v, user_id AS u, ts FROM events) AS src"


def _events(t):
    return t.table("events").select(
        F.col("event_id").alias("id"), cents("value").alias("v"), F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("ts")
    )


_RAW = "CASE id % 9 WHEN 0 THEN -9999.9 WHEN 1 THEN -99.0 WHEN 2 THEN -1111.1 WHEN 3 THEN -9999.96 ELSE CAST(v AS DOUBLE) / 10.0 END"


def _fill(t):
    raw = F.expr(_RAW).cast("double")
    df = _events(t).withColumn("raw", raw)
    return df.select(
        "id",
        S.decode_fill("raw", scale=0.1, offset=5.0).alias("value"),
        S.decode_fill("raw", C.GEO_FILL_SENTINELS).alias("geo"),
        F.element_at(S.decode_fill_array(F.array("raw", F.col("raw") + 1.0)), 2).alias("second"),
    )


def _sent(x, values):
    return " OR ".join(f"abs(({x}) - ({v})) <= 0.05" for v in values)


register(
    "P1_decode_fill",
    _fill,
    f"""SELECT id, CASE WHEN NOT ({_sent('raw', C.FILL_SENTINELS)}) THEN raw * CAST(0.1 AS DOUBLE) + 5.0 END AS value,
        CASE WHEN NOT ({_sent('raw', C.GEO_FILL_SENTINELS)}) THEN raw END AS geo,
        CASE WHEN NOT ({_sent('raw + 1.0', C.FILL_SENTINELS)}) THEN raw + 1.0 END AS second
        FROM (SELECT id, CAST({_RAW} AS DOUBLE) AS raw FROM {_E}) AS r""",
    doubles="value geo second",
)


def _band_gate(t):
    df = _events(t).withColumn(
        "cube", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.array(F.col("v") + b * 10, -(F.col("v") + b)))
    )
    df = df.withColumns({"ku": S.select_band("cube", 0), "gate": (F.pmod(F.col("id"), F.lit(13)) - 1).cast("int")})
    return df.select("id", F.aggregate("ku", F.lit(0).cast("long"), lambda a, x: a + x).alias("ku_sum"), S.gate_value("ku", "gate").cast("double").alias("at_gate"))


register(
    "P2_P3_band_and_gate",
    _band_gate,
    f"""SELECT id, 10 * v + 450 AS ku_sum, CASE WHEN id % 13 - 1 BETWEEN 0 AND 9 THEN v + (id % 13 - 1) * 10 END AS at_gate FROM {_E}""",
    longs="ku_sum",
    doubles="at_gate",
)
register(
    "P4_scan_time",
    lambda t: _events(t).select(
        "id",
        S.scan_time(
            F.when(F.pmod(F.col("id"), F.lit(17)) == 3, F.lit(-9999)).otherwise(F.year("ts")),
            F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts"),
            F.when(F.pmod(F.col("id"), F.lit(5)) == 0, F.lit(-99)).otherwise(F.pmod(F.col("v"), F.lit(1000))),
        ).alias("scan_time"),
    ).withColumn("scan_time", F.unix_micros("scan_time").cast("double")),
    f"""SELECT id, CASE WHEN id % 17 <> 3 THEN epoch_us(date_trunc('second', ts))
        + CASE WHEN id % 5 = 0 THEN 0 ELSE (v % 1000) * 1000 END END AS scan_time FROM {_E}""",
    doubles="scan_time",
    digits=0,
)


def _heights(t):
    zen = F.when(F.pmod(F.col("id"), F.lit(11)) == 0, F.lit(-9999.0)).otherwise(F.pmod(F.col("v"), F.lit(95)).cast("double"))
    df = _events(t).select("id", S.bin_heights(zen).alias("h"))
    return df.select("id", F.size("h").alias("n_bins"), F.element_at("h", 1).alias("top"), F.element_at("h", 101).alias("mid"), F.element_at("h", 176).alias("ground"))


_COS = "CASE WHEN id % 11 = 0 THEN 1.0 ELSE cos(radians(least(CAST(v % 95 AS DOUBLE), 89.0))) END"
register(
    "P5_bin_height",
    _heights,
    f"SELECT id, 176 AS n_bins, 175 * 125.0 * {_COS} AS top, 75 * 125.0 * {_COS} AS mid, CAST(0 AS DOUBLE) AS ground FROM {_E}",
    doubles="top mid ground",
    longs="n_bins",
)
register(
    "P6_rain_type",
    lambda t: _events(t).groupBy(S.rain_type(F.expr("CASE WHEN id % 7 = 0 THEN -9999 ELSE (v % 4) * 10000000 + v END")).alias("rain_type")).agg(F.count("*").alias("n")),
    f"""SELECT rain_type, count(*) AS n FROM (SELECT CASE WHEN id % 7 = 0 THEN -1 ELSE ((v % 4) * 10000000 + v) // 10000000 END AS rain_type
        FROM {_E}) AS r GROUP BY 1""",
    longs="rain_type n",
)
register(
    "P7_pct",
    lambda t: t.imager.select("mission", "orbit", "channel", "scan", "ray", "pct"),
    """SELECT mission, orbit, channel, scan, ray, pct FROM img""",
    doubles="pct",
    longs="orbit scan ray",
)
register(
    "P9_feature_id",
    lambda t: t.table("orders").select(
        S.encode_feature_id(
            F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.lit("gpm")).otherwise(F.lit("TRMM")),
            F.pmod("o_orderkey", F.lit(100000)), F.pmod("o_custkey", F.lit(99999)) + 1,
        ).alias("feature_id")
    ).select("feature_id", S.decode_feature_id("feature_id").alias("d")).select("feature_id", "d.*"),
    """SELECT CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END * 10000000000000 + (o_orderkey % 100000) * 100000 + o_custkey % 99999 + 1 AS feature_id,
       CASE WHEN o_custkey % 2 = 0 THEN 'GPM' ELSE 'TRMM' END AS mission, o_orderkey % 100000 AS orbit, o_custkey % 99999 + 1 AS local_label
       FROM orders""",
    longs="feature_id orbit local_label",
)
_CODE = "CASE WHEN id % 10 = 0 THEN -1 ELSE v % 400 END"
register(
    "P10_surface_class",
    lambda t: _events(t).groupBy(S.surface_class(F.expr(_CODE)).alias("surface")).agg(F.count("*").alias("n")),
    f"""SELECT surface, count(*) AS n FROM (SELECT CASE WHEN code < 0 THEN -1 WHEN code < 100 THEN 0 WHEN code < 200 THEN 1 ELSE 2 END AS surface
        FROM (SELECT {_CODE} AS code FROM {_E}) AS a) AS b GROUP BY 1""",
    longs="surface n",
)
register(
    "P11_P12_P13_storm_classes",
    lambda t: t.features.groupBy(
        S.size_class("major_axis_km").alias("size_class"),
        S.echotop_class("max_ht_20dbz").alias("echotop_class"),
        S.raintype_class(F.col("npixels") % 5 - 1).cast("double").alias("raintype"),
    ).agg(F.count("*").alias("n")),
    f"""SELECT {size_case('major_axis_km')} AS size_class, {echo_case('max_ht_20dbz')} AS echotop_class,
        CASE WHEN npixels % 5 - 1 IN (1, 2, 3) THEN npixels % 5 - 2 END AS raintype, count(*) AS n FROM cat GROUP BY 1, 2, 3""",
    longs="size_class echotop_class n",
    doubles="raintype",
)
register(
    "P14_P15_grid_bins",
    lambda t: t.features.select(
        "feature_id", S.lat_bin("centroid_lat").alias("lat_bin"), S.lon_bin(F.col("centroid_lon") + 150).alias("lon_bin")
    )
    .where(F.col("lat_bin").between(*S.lat_clip_bins("TRMM")))
    .withColumns({"lat": S.cell_lat("lat_bin"), "lon": S.cell_lon("lon_bin")}),
    f"""SELECT *, -90.0 + (lat_bin + 0.5) * CAST(0.05 AS DOUBLE) AS lat, -180.0 + (lon_bin + 0.5) * CAST(0.05 AS DOUBLE) AS lon FROM (
        SELECT feature_id, {latbin('centroid_lat', 0.05)} AS lat_bin, {lonbin('(centroid_lon + 150)', 0.05)} AS lon_bin FROM cat) AS b
        WHERE lat_bin BETWEEN floor((-38 + 90.0) / CAST(0.05 AS DOUBLE)) AND floor((38 + 90.0) / CAST(0.05 AS DOUBLE))""",
    doubles="lat lon",
    longs="lat_bin lon_bin",
)
register(
    "P16_P17_P18_views_by_hour",
    lambda t: t.pixels.where(S.is_view(ts="time") & S.in_window("time", "1996-03-01", "1999-07-01"))
    .groupBy(S.utc_hour("time").alias("hour")).agg(F.count("*").alias("n")),
    """SELECT hour(time) AS hour, count(*) AS n FROM pix WHERE near_sfc_rain IS NOT NULL
       AND time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1999-07-01' GROUP BY 1""",
    longs="hour n",
)


def _grid_rows(t):
    df = t.pixels.select(
        S.lat_bin("lat", 0.25).alias("lat_bin"), S.lon_bin("lon", 0.25).alias("lon_bin"), (F.hour("time") + F.when(F.col("ray") == 0, 20).otherwise(0)).alias("hour"),
        (F.col("scan") % 5).alias("size_class"), (F.col("scan") % 6).alias("echotop_class"), (F.col("scan") % 3).alias("raintype"),
        F.when(F.col("scan") % 11 == 0, F.lit(float("nan"))).when(F.col("scan") % 13 == 0, -1.0).otherwise(F.col("near_sfc_rain")).alias("rain_sum"),
        (F.col("ray") * F.when(F.col("scan") % 17 == 0, 10_000_000).otherwise(1)).cast("long").alias("raining_count"),
    )
    return df.withColumn("n_views", F.col("raining_count"))


def _sane(t):
    return _grid_rows(t).groupBy("raintype").agg(
        F.count_if(S.sane_rain(0.25)).alias("rain_ok"), F.count_if(S.sane_views(0.25)).alias("views_ok"),
        F.count_if(S.sane_metrics(0.25)).alias("metrics_ok"), F.count("*").alias("n"),
    )


register(
    "P19_sanity",
    _sane,
    """SELECT raintype, count(*) FILTER (WHERE hr BETWEEN 0 AND 23 AND cnt > 0 AND cnt < 100000000 AND rain_sum >= 0 AND NOT isnan(rain_sum) AND echo <= 4) AS rain_ok,
       count(*) FILTER (WHERE hr BETWEEN 0 AND 23 AND cnt > 0 AND cnt < 100000000) AS views_ok,
       count(*) FILTER (WHERE hr BETWEEN 0 AND 23) AS metrics_ok, count(*) AS n
       FROM (SELECT scan % 3 AS raintype, scan % 6 AS echo, hour(time) + CASE WHEN ray = 0 THEN 20 ELSE 0 END AS hr,
             ray * CASE WHEN scan % 17 = 0 THEN 10000000 ELSE 1 END AS cnt,
             CASE WHEN scan % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN scan % 13 = 0 THEN -1.0 ELSE near_sfc_rain END AS rain_sum FROM pix) AS s GROUP BY 1""",
    longs="raintype rain_ok views_ok metrics_ok n",
)
register(
    "P19_implausible_rows",
    lambda t: validate.implausible(_grid_rows(t), S.sane_rain(0.25)).groupBy("raintype", "echotop_class").agg(F.count("*").alias("n"), F.max("raining_count").alias("most")),
    """SELECT raintype, echo AS echotop_class, count(*) AS n, max(cnt) AS most FROM (
         SELECT scan % 3 AS raintype, scan % 6 AS echo, hour(time) + CASE WHEN ray = 0 THEN 20 ELSE 0 END AS hr, ray * CASE WHEN scan % 17 = 0 THEN 10000000 ELSE 1 END AS cnt,
                CASE WHEN scan % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN scan % 13 = 0 THEN -1.0 ELSE near_sfc_rain END AS rain_sum FROM pix) AS s
       WHERE (hr BETWEEN 0 AND 23 AND cnt > 0 AND cnt < 100000000 AND rain_sum >= 0 AND NOT isnan(rain_sum) AND echo <= 4) IS NOT TRUE GROUP BY 1, 2""",
    longs="raintype echotop_class n most",
)
register(
    "P20_great_circle",
    lambda t: t.features.select("feature_id", S.haversine_km("centroid_lat", "centroid_lon", F.lit(12.5), F.lit(-45.25)).alias("km")),
    f"SELECT feature_id, {hav('centroid_lat', 'centroid_lon', '12.5', '-45.25')} AS km FROM cat",
    doubles="km",
    digits=5,
)
register(
    "P21_P22_population_by_solar_hour",
    lambda t: t.features.groupBy(S.population().alias("pop"), S.local_solar_hour("time", "centroid_lon").alias("lst")).agg(F.count("*").alias("n")),
    f"""SELECT {POP} AS pop, ((CAST(floor(hour(time) + minute(time) / CAST(60 AS DOUBLE) + centroid_lon / 15.0) AS BIGINT) % 24) + 24) % 24 AS lst,
        count(*) AS n FROM cat GROUP BY 1, 2""",
    longs="lst n",
)
_REG = " UNION ALL ".join(
    f"SELECT '{n}' AS region, feature_id FROM cat WHERE centroid_lat BETWEEN {a} AND {b} AND centroid_lon BETWEEN {c} AND {d}"
    for n, (a, b, c, d) in C.REGIONS.items()
)
register("P23_regions", lambda t: in_regions(t.features).select("region", "feature_id"), _REG)


def _extreme(t):
    from rainloom.operators.environment import analysis_columns

    fe = analysis_columns(t.features)
    return (
        fe.withColumn("x", S.is_extreme_abs())
        .groupBy(S.convective().alias("conv"))
        .agg(*[F.count_if(F.col(f"x.{k}")).alias(k) for k in ("ht40", "ht30", "pct37", "pct85")], F.count("*").alias("n"))
    )


register(
    "P24_P25_convective_extremes",
    _extreme,
    """SELECT (max_ht_30dbz / 1000.0 > 0 OR conv_area_km2 > 0) IS TRUE AS conv, count(*) FILTER (WHERE max_ht_40dbz / 1000.0 >= 14) AS ht40,
       count(*) FILTER (WHERE max_ht_30dbz / 1000.0 >= 16) AS ht30, count(*) FILTER (WHERE min_pct_37 <= 150) AS pct37,
       count(*) FILTER (WHERE min_pct_85_89 <= 100) AS pct85, count(*) AS n FROM cat GROUP BY 1""",
    longs="ht40 ht30 pct37 pct85 n",
)
register(
    "S1_flag_bits",
    lambda t: _events(t).groupBy(*[S.has_flag(F.pmod("v", F.lit(256)), b).alias(f"bit{b}") for b in (1, 8, 32, 128)]).agg(F.count("*").alias("n")),
    f"""SELECT (v % 256) & 1 <> 0 AS bit1, (v % 256) & 8 <> 0 AS bit8, (v % 256) & 32 <> 0 AS bit32, (v % 256) & 128 <> 0 AS bit128,
        count(*) AS n FROM {_E} GROUP BY 1, 2, 3, 4""",
    longs="n",
)
