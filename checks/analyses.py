"""Catalogue analyses, window helpers, environment-conditioned statistics, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import CTES, POP, floor_div, register
from rainloom import constants as C
from rainloom.functions import ranking as rk
from rainloom.operators.environment import build_analysis_table, left_env
from rainloom.plans import catalogue as ct
from rainloom.plans import conditioned as cd
from rainloom.plans import boosting, models
from rainloom.session import materialize

ENV_COLS = [c for c in C.PREDICTORS if c != "abs_lat"]

# --- windows --------------------------------------------------------------

register(
    "W1_orbit_start",
    lambda t: rk.orbit_start(t.features).select("feature_id", "orbit_start"),
    "SELECT feature_id, epoch_us(min(time) OVER (PARTITION BY mission, orbit)) AS orbit_start FROM cat",
    longs="feature_id orbit_start",
)
register(
    "W2_share_by_return_flag",
    lambda t: rk.share_of_total(
        t.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), "qty", ("l_linestatus",)),
    """SELECT *, 100.0 * qty / sum(qty) OVER (PARTITION BY l_linestatus) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) AS g""",
    doubles="qty share",
    longs="n",
)
register(
    "W3_cape_quartiles",
    lambda t: rk.quantile_group(t.features.select("feature_id", "mission", C.CAPE_COL), C.CAPE_COL, 4, "feature_id", ("mission",)).select("feature_id", "quantile"),
    "SELECT feature_id, ntile(4) OVER (PARTITION BY mission ORDER BY p90_cape_2p50deg, feature_id) AS quantile FROM cat WHERE p90_cape_2p50deg IS NOT NULL",
    longs="feature_id quantile",
)
register(
    "W3_row_numbers",
    lambda t: rk.row_numbers(t.table("lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"),
                             ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"], ("l_returnflag",))
    .groupBy("l_returnflag").agg(F.max("rn").alias("n"), F.max("rn_total").alias("total"), F.sum(F.when(F.col("rn") % 1000 == 1, F.col("l_extendedprice"))).alias("marks")),
    """SELECT l_returnflag, max(rn) AS n, count(*) AS total, sum(l_extendedprice) FILTER (WHERE rn % 1000 = 1) AS marks FROM (
       SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber) AS rn FROM lineitem) AS r GROUP BY 1""",
    doubles="marks",
    longs="n total",
    digits=2,
)
register(
    "W4_cumulative_order_value",
    lambda t: rk.cumulative_share(
        t.table("orders").groupBy("o_orderstatus", F.floor(F.log10("o_totalprice") / F.lit(0.2)).cast("int").alias("b")).agg(F.sum("o_totalprice").alias("v")), "b", "v", ("o_orderstatus",)),
    f"""SELECT *, 100.0 * sum(v) OVER (PARTITION BY o_orderstatus ORDER BY b) / sum(v) OVER (PARTITION BY o_orderstatus) AS cumulative FROM (
        SELECT o_orderstatus, {floor_div('log10(o_totalprice)', 0.2)} AS b, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) AS g""",
    doubles="v cumulative",
    longs="b",
    v=2,
)
register(
    "W5_deepest_features",
    lambda t: rk.top_k(t.features, "max_ht_40dbz", 10, True, ("mission",)).select("mission", "feature_id", "max_ht_40dbz", "rank"),
    """SELECT mission, feature_id, max_ht_40dbz, row_number() OVER w AS rank FROM cat WHERE max_ht_40dbz IS NOT NULL
       WINDOW w AS (PARTITION BY mission ORDER BY max_ht_40dbz DESC, feature_id) QUALIFY rank <= 10""",
    doubles="max_ht_40dbz",
    longs="feature_id rank",
)
register(
    "W5_coldest_overall",
    lambda t: rk.top_k(t.features, "min_pct_85_89", 10, False).select("feature_id", "min_pct_85_89"),
    "SELECT feature_id, min_pct_85_89 FROM cat WHERE min_pct_85_89 IS NOT NULL ORDER BY min_pct_85_89, feature_id LIMIT 10",
    doubles="min_pct_85_89",
    longs="feature_id",
)
register(
    "W6_argmax",
    lambda t: rk.argmax_by(t.table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("qty")), "qty", "l_linenumber", ("l_suppkey",)),
    """SELECT l_suppkey, l_linenumber, qty FROM (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) AS g
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_linenumber) = 1""",
    doubles="qty",
    longs="l_suppkey l_linenumber",
)
register(
    "W7_relative_to_mean",
    lambda t: rk.normalise_to_mean(t.table("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("qty")), "qty", ("l_returnflag",)),
    """SELECT *, qty / avg(qty) OVER (PARTITION BY l_returnflag) AS normalised FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) AS g""",
    doubles="qty normalised",
    longs="l_linenumber",
)
def _order_in_files(t):
    """Whether each row of a sorted write comes after the one before it in its file."""
    from rainloom.session import materialize

    df = t.features.repartition(7, "npixels").select("feature_id", "npixels")
    back = rk.with_ordinal(materialize(rk.sort_within(df, "feature_id"), "sorted")).withColumn("file", F.input_file_name())
    before = F.lag("feature_id").over(Window.partitionBy("file").orderBy("ordinal"))
    return back.select("feature_id", F.coalesce(before <= F.col("feature_id"), F.lit(True)).alias("in_order"))


register(
    "W8_ordinal_of_rows",
    # the source is one file, so its rows are numbered in file order
    lambda t: rk.row_numbers(rk.with_ordinal(t.table("orders").select("o_orderkey")), ["ordinal"]).select("o_orderkey", "rn"),
    "SELECT o_orderkey, row_number() OVER () AS rn FROM orders",
    longs="o_orderkey rn",
)


def _ordinals(t):
    """Ordinals of a table of several files, in splits of a few KB: rows of a file keep its order, files that of their names."""
    from rainloom.session import materialize

    df = t.table("orders").select("o_orderkey")
    stored = materialize(df.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey"), "ordered")
    conf, key = t.spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(key)
    conf.set(key, "16k")
    try:
        return materialize(rk.input_ordinal(t.spark.read.parquet(stored.stored_at)), "ordinals")
    finally:
        conf.set(key, before)


register(
    "W8_ordinal_of_files",
    _ordinals,
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders",
    longs="o_orderkey ordinal",
)
register(
    "W9_order_in_files",
    _order_in_files,
    "SELECT feature_id, true AS in_order FROM cat",
    longs="feature_id",
)
register(
    "W8_W9_input_order_kept",
    lambda t: rk.sort_within(rk.with_ordinal(t.features.select("feature_id", "area_km2")), "feature_id").select("feature_id", "area_km2"),
    "SELECT feature_id, area_km2 FROM cat",
    doubles="area_km2",
    longs="feature_id",
)
register(
    "W10_thin_groups_left_out",
    lambda t: rk.min_count(t.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), 14),
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 14",
    longs="o_custkey n",
)
register(
    "S2_exact_percentiles",
    lambda t: rk.exact_percentiles(t.table("lineitem"), ("l_returnflag", "l_linestatus"), "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p999": 0.999}),
    """SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999,
       count(*) AS n FROM lineitem GROUP BY 1, 2""",
    doubles="p10 p50 p999",
    longs="n",
    digits=5,
)

# --- feature catalogue ----------------------------------------------------

_RAIN = "sum(volrain_total)"
_OL = "CASE WHEN frac_ocean >= 0.5 THEN 'ocean' ELSE '{}' END"

register(
    "F1_class_contribution",
    lambda t: ct.class_contribution(t.features, "TRMM"),
    f"""SELECT *, 100.0 * n_feat / sum(n_feat) OVER () AS pct_feat, 100.0 * rain / sum(rain) OVER () AS pct_rain FROM (
        SELECT feature_class, count(*) AS n_feat, {_RAIN} AS rain, avg(area_km2) AS mean_area_km2, avg(min_pct_85_89) AS mean_min_pct,
        100.0 * sum(volrain_conv) / {_RAIN} AS conv_rain_pct FROM cat WHERE mission = 'TRMM' GROUP BY 1) AS g""",
    doubles="rain mean_area_km2 mean_min_pct conv_rain_pct pct_feat pct_rain",
    longs="n_feat",
    rain=5,
)
register(
    "F1_order_status_contribution",
    lambda t: rk.share_of_total(rk.share_of_total(
        t.table("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")), "n", name="pct_n"), "v", name="pct_v"),
    """SELECT *, 100.0 * n / sum(n) OVER () AS pct_n, 100.0 * v / sum(v) OVER () AS pct_v FROM (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) AS g""",
    doubles="v pct_n pct_v",
    longs="n",
    v=2,
)
register(
    "F2_rain_by_size",
    lambda t: ct.rain_by_size(t.features, "GPM"),
    f"""SELECT *, 100.0 * rain / sum(rain) OVER (PARTITION BY surf) AS share, 100.0 * sum(rain) OVER (PARTITION BY surf ORDER BY b) / sum(rain) OVER (PARTITION BY surf) AS cumulative
        FROM (SELECT {_OL.format('land/coast')} AS surf, {floor_div('log10(area_km2)', 0.2)} AS b, {_RAIN} AS rain FROM cat WHERE mission = 'GPM' AND area_km2 > 0 GROUP BY 1, 2) AS g""",
    doubles="rain share cumulative",
    longs="b",
    rain=5,
)
register(
    "F3_rain_by_intensity",
    lambda t: ct.rain_by_intensity(t.features, "TRMM"),
    f"""SELECT *, 100.0 * rain / sum(rain) OVER (PARTITION BY axis) AS share FROM (
        SELECT 'ht40' AS axis, {floor_div('max_ht_40dbz', 1000)} AS b, {_RAIN} AS rain FROM cat WHERE mission = 'TRMM' AND max_ht_40dbz IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'pct85', {floor_div('min_pct_85_89', 10)} * 10, {_RAIN} FROM cat WHERE mission = 'TRMM' AND min_pct_85_89 IS NOT NULL GROUP BY 2) AS g""",
    doubles="rain share",
    longs="b",
    rain=5,
)
register(
    "F4_share_by_surface",
    lambda t: ct.conv_strat_share(t.features, "GPM"),
    f"SELECT {POP} AS surf, 100.0 * sum(volrain_conv) / {_RAIN} AS conv_pct, 100.0 * sum(volrain_strat) / {_RAIN} AS strat_pct FROM cat WHERE mission = 'GPM' GROUP BY 1",
    doubles="conv_pct strat_pct",
)
register(
    "F4_share_by_latitude",
    lambda t: ct.conv_strat_share(t.features, None, "latitude"),
    f"""SELECT floor(centroid_lat / 2.5) * 2.5 + 1.25 AS lat, 100.0 * sum(volrain_conv) / {_RAIN} AS conv_pct, 100.0 * sum(volrain_strat) / {_RAIN} AS strat_pct
        FROM cat GROUP BY 1""",
    doubles="lat conv_pct strat_pct",
)
register(
    "F5_rain_map",
    lambda t: ct.rain_map(t.features, "TRMM"),
    f"""SELECT *, 100.0 * rain_mcs / nullif(rain_all, 0) AS mcs_pct FROM (SELECT CAST(least(143, floor((centroid_lon + 180.0) / 2.5)) AS BIGINT) AS ix, CAST(least(71, floor((centroid_lat + 90.0) / 2.5)) AS BIGINT) AS iy,
        {_RAIN} AS rain_all, coalesce(sum(volrain_total) FILTER (WHERE feature_class = 'MCS'), 0) AS rain_mcs FROM cat
        WHERE mission = 'TRMM' AND centroid_lon >= -180 AND centroid_lon < 180 GROUP BY 1, 2) AS g""",
    doubles="rain_all rain_mcs mcs_pct",
    longs="ix iy",
    digits=5,
)
_LSTF = "((CAST(floor(hour(time) + minute(time) / CAST(60 AS DOUBLE) + centroid_lon / 15.0) AS BIGINT) % 24) + 24) % 24"


def _diurnal_sql(group, where):
    return f"""SELECT grp, lst, coalesce(r, 0) AS rain, coalesce(r, 0) / avg(coalesce(r, 0)) OVER (PARTITION BY grp) AS normalised
      FROM (SELECT grp, lst FROM (SELECT DISTINCT {group} AS grp FROM cat WHERE {where}) AS g, (SELECT unnest(range(24)) AS lst) AS h) AS full_day
      LEFT JOIN (SELECT {group} AS grp, {_LSTF} AS lst, {_RAIN} AS r FROM cat WHERE {where} GROUP BY 1, 2) x USING (grp, lst)"""


register("F6_diurnal_by_surface", lambda t: ct.diurnal_features(t.features, "TRMM"), _diurnal_sql(_OL.format("land"), "mission = 'TRMM'"),
         doubles="rain normalised", longs="lst", rain=5)
register("F6_diurnal_by_mcs", lambda t: ct.diurnal_features(t.features, "GPM", "mcs"),
         _diurnal_sql("CASE WHEN is_mcs THEN 'MCS' ELSE 'non-MCS' END", "mission = 'GPM'"), doubles="rain normalised", longs="lst", rain=5)
register(
    "F7_size_rate_histogram",
    lambda t: ct.size_rate_histogram(t.features),
    f"""SELECT {floor_div('log10(area_km2)', 0.2)} AS area_bin, CAST(least(49, floor(least(volrain_total / area_km2, 25.0) / 0.5)) AS BIGINT) AS rate_bin,
        count(*) AS n, {_RAIN} AS rain FROM cat WHERE area_km2 > 0 AND volrain_total > 0 GROUP BY 1, 2""",
    doubles="rain",
    longs="area_bin rate_bin n",
    digits=5,
)
CTES["reg_cat"] = " UNION ALL ".join(
    f"SELECT '{n}' AS region, * FROM cat WHERE centroid_lat BETWEEN {a} AND {b} AND centroid_lon BETWEEN {c} AND {d}"
    for n, (a, b, c, d) in C.REGIONS.items()
)
register(
    "F8_regional_morphology",
    lambda t: ct.regional_morphology(t.features, "GPM"),
    f"""SELECT region, 100.0 * sum(volrain_total) FILTER (WHERE feature_class = 'MCS') / {_RAIN} AS mcs_rain_pct, 100.0 * sum(volrain_conv) / {_RAIN} AS conv_pct,
        avg(max_ht_40dbz) / 1000.0 AS mean_ht_km, avg(min_pct_85_89) AS mean_min_pct, count(*) AS n FROM reg_cat WHERE mission = 'GPM' GROUP BY 1""",
    doubles="mcs_rain_pct conv_pct mean_ht_km mean_min_pct",
    longs="n",
)
register(
    "F9_monthly_inventory",
    lambda t: ct.monthly_inventory(t.features),
    """SELECT g.*, median_n, n_pfs < 0.2 * median_n AS is_low FROM (SELECT mission, year(time) AS year, month(time) AS month, count(*) AS n_pfs FROM cat GROUP BY 1, 2, 3) g
       JOIN (SELECT mission, quantile_cont(n, 0.5) AS median_n FROM (SELECT mission, count(*) AS n FROM cat GROUP BY mission, year(time), month(time)) AS c GROUP BY 1) m USING (mission)""",
    doubles="median_n",
    longs="year month n_pfs",
)
register(
    "F10_count_map",
    lambda t: ct.count_map(t.features, "GPM"),
    """SELECT CAST(least(1439, floor((centroid_lon + 180.0) / 0.25)) AS BIGINT) AS ix, CAST(least(719, floor((centroid_lat + 90.0) / 0.25)) AS BIGINT) AS iy, count(*) AS n
       FROM cat WHERE mission = 'GPM' AND centroid_lon >= -180 AND centroid_lon < 180 GROUP BY 1, 2""",
    longs="ix iy n",
)
register(
    "F11_longitude_profile",
    lambda t: ct.longitude_profile(t.features),
    f"SELECT CAST(floor(centroid_lon) AS BIGINT) AS lon_bin, {POP} AS pop, count(*) AS n FROM cat WHERE centroid_lon >= -105 AND centroid_lon < -95 GROUP BY 1, 2",
    longs="lon_bin n",
)
register(
    "F12_population_table",
    lambda t: ct.population_table(t.features),
    f"""SELECT mission, land, ocean, coast, total, 100.0 * land / total AS land_pct, 100.0 * ocean / total AS ocean_pct, 100.0 * coast / total AS coast_pct FROM (
        SELECT mission, count(*) FILTER (WHERE pop = 'land') AS land, count(*) FILTER (WHERE pop = 'ocean') AS ocean, count(*) FILTER (WHERE pop = 'coast') AS coast, count(*) AS total
        FROM (SELECT mission, {POP} AS pop FROM cat) AS p GROUP BY 1) AS g""",
    doubles="land_pct ocean_pct coast_pct",
    longs="land ocean coast total",
)
_WIDTH = f"CAST({20.0 / 60} AS DOUBLE)"
register(
    "F13_height_pdf",
    lambda t: ct.pdf_by_population(t.features, F.col("max_ht_40dbz") / 1000.0, 0.0, 20.0, positive_only=True, mission="TRMM"),
    f"""SELECT pop, b, n, total, n / (total * {_WIDTH}) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY pop) AS total FROM (
        SELECT {POP} AS pop, CAST(least(greatest(floor(max_ht_40dbz / 1000.0 / {_WIDTH}), 0), 59) AS BIGINT) AS b, count(*) AS n FROM cat
        WHERE mission = 'TRMM' AND max_ht_40dbz > 0 AND max_ht_40dbz / 1000.0 < 20 GROUP BY 1, 2) AS g) AS h WHERE total > 10""",
    doubles="density",
    longs="b n total",
)
_WIDTH2 = f"CAST({250.0 / 60} AS DOUBLE)"
register(
    "F13_temperature_pdf",
    lambda t: ct.pdf_by_population(t.features, "min_pct_85_89", 50.0, 300.0, mission="GPM"),
    f"""SELECT pop, b, n, total, n / (total * {_WIDTH2}) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY pop) AS total FROM (
        SELECT {POP} AS pop, CAST(least(greatest(floor((min_pct_85_89 - 50.0) / {_WIDTH2}), 0), 59) AS BIGINT) AS b, count(*) AS n FROM cat
        WHERE mission = 'GPM' AND min_pct_85_89 >= 50 AND min_pct_85_89 < 300 GROUP BY 1, 2) AS g) AS h WHERE total > 10""",
    doubles="density",
    longs="b n total",
)
register(
    "F14_mission_totals",
    lambda t: ct.mission_totals(t.features),
    f"SELECT mission, count(*) AS n, {_RAIN} AS rain, min(centroid_lat) AS lat_lo, max(centroid_lat) AS lat_hi FROM cat GROUP BY 1",
    doubles="rain lat_lo lat_hi",
    longs="n",
    rain=5,
)

# --- environment-conditioned ----------------------------------------------


def fe(t):
    """Analysis table: the catalogue joined with its environment columns."""
    env = t.features.select("feature_id", "mission", "orbit", "time", *ENV_COLS)
    return build_analysis_table(t.features.drop(*ENV_COLS), env)


def model_rows(t):
    """What models take of the analysis table, written once; whoever passes over it repeatedly would repeat its join."""
    if not hasattr(t, "_model_rows"):
        t._model_rows = materialize(fe(t).select("feature_id", "surf", "ht40_km", *C.PREDICTORS), "analysis")
    return t._model_rows


_CB, _SB = floor_div("p90_cape_2p50deg", 250), floor_div("shear_6000m_centroid", 2)
_IN = "p90_cape_2p50deg < 5000 AND shear_6000m_centroid < 30"

register(
    "J2_analysis_table",
    lambda t: fe(t).select("feature_id", "surf", "abs_lat", "ht20_km", "ht30_km", "ht40_km", *ENV_COLS),
    f"SELECT feature_id, surf, abs_lat, ht20_km, ht30_km, ht40_km, {', '.join(ENV_COLS)} FROM fe",
    doubles=f"abs_lat ht20_km ht30_km ht40_km {' '.join(ENV_COLS)}",
    longs="feature_id",
)
register(
    "J11_features_without_environment",
    lambda t: left_env(
        t.features.select("feature_id", "mission"),
        t.features.where("p90_cape_2p50deg > 2000").select("feature_id", "mission", "orbit", "time", "p90_cape_2p50deg"),
    ),
    "SELECT feature_id, mission, CASE WHEN p90_cape_2p50deg > 2000 THEN p90_cape_2p50deg END AS p90_cape_2p50deg FROM cat",
    doubles="p90_cape_2p50deg",
    longs="feature_id",
)


def _comp(value, where):
    return f"""SELECT {_CB} AS cape_bin, {_SB} AS shear_bin, CASE WHEN count(*) >= 5 THEN {value} END AS val, count(*) AS n FROM fe WHERE {_IN} AND {where} GROUP BY 1, 2"""


for _stat, _sql in (("median", "quantile_cont(ht40_km, 0.5)"), ("p90", "quantile_cont(ht40_km, 0.9)"), ("mean", "avg(ht40_km)")):
    register(
        f"H1_composite_{_stat}",
        lambda t, s=_stat: cd.composite_2d(fe(t), "ht40_km", s, 5, "GPM", "ocean"),
        _comp(_sql, "ht40_km IS NOT NULL AND mission = 'GPM' AND surf = 'ocean' AND is_conv"),
        doubles="val",
        longs="cape_bin shear_bin n",
    )
register(
    "H2_fixed_cape_lines",
    lambda t: cd.fixed_cape_lines(fe(t), "ht30_km", "median", 10, "GPM", "ocean"),
    f"""SELECT cape_quartile, shear_bin, quantile_cont(ht30_km, 0.5) AS val, count(*) AS n FROM (SELECT ntile(4) OVER (ORDER BY p90_cape_2p50deg, feature_id) AS cape_quartile, {_SB} AS shear_bin, ht30_km
        FROM fe WHERE mission = 'GPM' AND surf = 'ocean' AND is_conv AND p90_cape_2p50deg IS NOT NULL AND ht30_km IS NOT NULL AND shear_6000m_centroid < 30) AS s
        GROUP BY 1, 2 HAVING count(*) >= 10""",
    doubles="val",
    longs="cape_quartile shear_bin n",
)
register(
    "H2_quartile_ranges",
    lambda t: cd.quartile_ranges(fe(t), "GPM", "land"),
    """SELECT q AS cape_quartile, min(c) AS lo, max(c) AS hi, count(*) AS n FROM (SELECT p90_cape_2p50deg AS c, ntile(4) OVER (ORDER BY p90_cape_2p50deg, feature_id) AS q
       FROM fe WHERE mission = 'GPM' AND surf = 'land' AND p90_cape_2p50deg IS NOT NULL) AS s GROUP BY 1""",
    doubles="lo hi",
    longs="cape_quartile n",
)
register(
    "H3_joint_density",
    lambda t: cd.joint_density(fe(t), "GPM", "ocean"),
    f"SELECT {_CB} AS cape_bin, {_SB} AS shear_bin, count(*) AS n FROM fe WHERE {_IN} AND mission = 'GPM' AND surf = 'ocean' GROUP BY 1, 2",
    longs="cape_bin shear_bin n",
)
register(
    "H4_correlation",
    lambda t: cd.cape_shear_corr(fe(t)),
    """SELECT mission, surf, corr(p90_cape_2p50deg, shear_6000m_centroid) AS cape_shear_corr, quantile_cont(p90_cape_2p50deg, 0.5) AS med_cape,
       quantile_cont(shear_6000m_centroid, 0.5) AS med_shear FROM fe GROUP BY 1, 2""",
    doubles="cape_shear_corr med_cape med_shear",
)
register(
    "H5_population_counts",
    lambda t: cd.population_counts(fe(t)),
    """SELECT mission, surf, count(*) AS n, count(*) FILTER (WHERE ht40_km > 0) AS deep_40dbz, avg(shear_6000m_centroid) AS mean_shear, avg(p90_cape_2p50deg) AS mean_cape
       FROM fe GROUP BY 1, 2""",
    doubles="mean_shear mean_cape",
    longs="n deep_40dbz",
)
register(
    "H6_mcs_share",
    lambda t: cd.mcs_share_2d(fe(t), 5, "GPM", "ocean"),
    f"""SELECT {_CB} AS cape_bin, {_SB} AS shear_bin, avg(CAST(is_mcs AS INT)) AS p_mcs, 100.0 * sum(volrain_total) FILTER (WHERE feature_class = 'MCS') / nullif(sum(volrain_total), 0) AS mcs_rain_pct,
        count(*) AS n FROM fe WHERE {_IN} AND mission = 'GPM' AND surf = 'ocean' GROUP BY 1, 2 HAVING count(*) >= 5""",
    doubles="p_mcs mcs_rain_pct",
    longs="cape_bin shear_bin n",
)
register(
    "H7_stratiform_in_mcs",
    lambda t: cd.stratiform_response(fe(t), "median", 5),
    _comp("quantile_cont(strat_area_km2, 0.5)", "strat_area_km2 IS NOT NULL AND feature_class = 'MCS'"),
    doubles="val",
    longs="cape_bin shear_bin n",
)
CTES["reg_fe"] = " UNION ALL ".join(
    f"SELECT '{n}' AS region, * FROM fe WHERE centroid_lat BETWEEN {a} AND {b} AND centroid_lon BETWEEN {c} AND {d}"
    for n, (a, b, c, d) in C.REGIONS_ENV.items()
)
register(
    "H8_regional_slope",
    lambda t: cd.regional_slope(fe(t), 3),
    f"""SELECT region, round(regr_slope(ht, sb), 3) AS slope, sum(n) AS n, round(arg_min(p, sb), 3) AS p_mcs_lo, round(arg_max(p, sb), 3) AS p_mcs_hi FROM (
        SELECT region, {_SB} * 2.0 AS sb, quantile_cont(ht40_km, 0.5) AS ht, avg(CAST(is_mcs AS INT)) AS p, count(*) AS n FROM reg_fe
        WHERE is_conv AND shear_6000m_centroid < 30 AND p90_cape_2p50deg BETWEEN 500 AND 3000 GROUP BY 1, 2 HAVING count(*) >= 3) AS b GROUP BY 1 HAVING count(*) >= 3""",
    doubles="slope p_mcs_lo p_mcs_hi",
    longs="n",
    digits=3,
)
register(
    "H9_sample",
    lambda t: cd.sample_rows(fe(t), ["feature_id", "ht20_km"], 500, mission="gpm", conv_only=True, where=F.col("ht20_km").isNotNull()),
    "SELECT feature_id, ht20_km FROM fe WHERE mission = 'GPM' AND is_conv AND ht20_km IS NOT NULL ORDER BY md5(CAST(feature_id AS VARCHAR) || ':0'), feature_id LIMIT 500",
    doubles="ht20_km",
    longs="feature_id",
)
register(
    "H10_prepared_predictors",
    lambda t: models.prepare_predictors(fe(t), "ht40_km").agg(
        F.count("*").alias("n"), *[F.avg(p).alias(f"m_{p}") for p in C.PREDICTORS], *[F.stddev_samp(p).alias(f"s_{p}") for p in C.PREDICTORS]),
    f"""SELECT count(*) AS n, {', '.join(f'avg({p}) AS m_{p}, stddev_samp({p}) AS s_{p}' for p in C.PREDICTORS)} FROM (
        SELECT * REPLACE (coalesce(mean_cin_2p50deg, 0.0) AS mean_cin_2p50deg) FROM fe WHERE ht40_km IS NOT NULL AND p90_cape_2p50deg IS NOT NULL) AS z""",
    doubles=" ".join(f"m_{p} s_{p}" for p in C.PREDICTORS),
    longs="n",
)
register(
    "H11_ols_two_predictors",
    lambda t: models.fit_ols(fe(t), "ht40_km", ("p90_cape_2p50deg", "shear_6000m_centroid")),
    """SELECT unnest(['p90_cape_2p50deg', 'shear_6000m_centroid', 'const']) AS term, unnest([sx * (vz * cxy - cxz * czy) / (vx * vz - cxz * cxz), sz * (vx * czy - cxz * cxy) / (vx * vz - cxz * cxz), my]) AS coefficient
       FROM (SELECT var_samp(x) AS vx, var_samp(z) AS vz, stddev_samp(x) AS sx, stddev_samp(z) AS sz, covar_samp(x, z) AS cxz, covar_samp(x, y) AS cxy, covar_samp(z, y) AS czy, avg(y) AS my
             FROM (SELECT p90_cape_2p50deg AS x, shear_6000m_centroid AS z, ht40_km AS y FROM fe WHERE ht40_km IS NOT NULL AND p90_cape_2p50deg IS NOT NULL) AS d) AS s""",
    doubles="coefficient",
)
# All predictors: each in turn is taken out of those after it and of the response, then the slopes are solved backwards.
_K = len(C.PREDICTORS)
CTES["ols_0"] = "SELECT y, " + ", ".join(f"(p{k} - avg(p{k}) OVER ()) / stddev_samp(p{k}) OVER () AS z{k}" for k in range(_K)) + (
    " FROM (SELECT CAST(ht40_km AS DOUBLE) AS y, " + ", ".join(f"CAST({f'coalesce({p}, 0.0)' if p == C.CIN_COL else p} AS DOUBLE) AS p{k}" for k, p in enumerate(C.PREDICTORS))
    + " FROM fe WHERE ht40_km IS NOT NULL AND " + " AND ".join(f"{p} IS NOT NULL" for p in C.PREDICTORS if p != C.CIN_COL) + ") AS d"
)
for _j in range(_K):
    _later = range(_j + 1, _K)
    CTES[f"ols_r{_j}"] = f"SELECT regr_slope(y, z{_j}) AS y{_j}" + "".join(f", regr_slope(z{k}, z{_j}) AS s{_j}_{k}" for k in _later) + f" FROM ols_{_j}"
    CTES[f"ols_{_j + 1}"] = f"SELECT y - y{_j} * z{_j} AS y" + "".join(f", z{k} - s{_j}_{k} * z{_j} AS z{k}" for k in _later) + f" FROM ols_{_j} CROSS JOIN ols_r{_j}"
register(
    "H11_ols",
    lambda t: models.fit_ols(fe(t), "ht40_km"),
    f"""SELECT unnest([{', '.join(f"'{p}'" for p in C.PREDICTORS)}, 'const']) AS term, unnest([{', '.join(f'b{k}' for k in range(_K))}, my]) AS coefficient FROM (
    SELECT {', '.join(f"y{j}" + "".join(f" - s{j}_{k} * b{k}" for k in range(j + 1, _K)) + f" AS b{j}" for j in reversed(range(_K)))}, (SELECT avg(y) FROM ols_0) AS my
    FROM {' CROSS JOIN '.join(f'ols_r{j}' for j in range(_K))}) AS b""",
    doubles="coefficient",
)
ROUNDS, DEPTH, STEP = 3, 2, 0.3


def _boost_sql(rows: str, name: str) -> None:
    """CTEs ``name`` (rows with their predictions after all rounds) and ``name_splits`` for the same exact splits.

    ``rows``: id, y, w, train, the predictors.
    """
    value = "CASE predictor " + " ".join(f"WHEN '{p}' THEN {p}" for p in C.PREDICTORS) + " END"
    CTES[f"{name}_in"] = rows
    CTES[f"{name}_0"] = f"SELECT d.*, m AS pred FROM {name}_in AS d CROSS JOIN (SELECT sum(w * y) / sum(w) AS m FROM {name}_in WHERE train) AS s"
    found = []
    for r in range(1, ROUNDS + 1):
        CTES[f"{name}_{r}_l0"] = f"SELECT *, 1 AS node FROM {name}_{r - 1}"
        for level in range(DEPTH):
            here = f"{name}_{r}_l{level}"
            long = " UNION ALL ".join(f"SELECT node, '{p}' AS predictor, {p} AS value, sum(w * (y - pred)) AS s, sum(w) AS n FROM {here} WHERE train AND node >= {1 << level} GROUP BY ALL" for p in C.PREDICTORS)
            CTES[f"{here}_best"] = f"""
SELECT node, arg_max(predictor, gain) AS predictor, arg_max(value, gain) AS threshold, max(gain) AS gain, max(nt) AS weight FROM (
  SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM (
    SELECT *, sum(s) OVER o AS sl, sum(n) OVER o AS nl, sum(s) OVER g AS st, sum(n) OVER g AS nt, row_number() OVER (PARTITION BY node, predictor ORDER BY value DESC) AS back
    FROM ({long}) AS v WINDOW o AS (PARTITION BY node, predictor ORDER BY value), g AS (PARTITION BY node, predictor)) AS run WHERE back > 1) AS cut GROUP BY node"""
            CTES[f"{name}_{r}_l{level + 1}"] = f"""
SELECT d.* REPLACE (CASE WHEN gain > 0 THEN 2 * node + CASE WHEN {value} <= threshold THEN 0 ELSE 1 END ELSE node END AS node) FROM {here} AS d LEFT JOIN {here}_best USING (node)"""
            found.append(f"SELECT {r} AS round, * FROM {here}_best WHERE gain > 0")
        last = f"{name}_{r}_l{DEPTH}"
        CTES[f"{name}_{r}"] = f"""
SELECT d.* EXCLUDE (node, leaf) REPLACE (pred + {STEP} * leaf AS pred) FROM (
  SELECT * FROM {last} JOIN (SELECT node, sum(w * (y - pred)) / sum(w) AS leaf FROM {last} WHERE train GROUP BY node) AS leaves USING (node)) AS d"""
    CTES[f"{name}_splits"] = " UNION ALL ".join(found)
    CTES[name] = f"SELECT * FROM {name}_{ROUNDS}"


_PART = "CAST('0x' || substr(md5(CAST(feature_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 <> 0"
_ALL = " AND ".join(f"{p} IS NOT NULL" for p in C.PREDICTORS if p != C.CIN_COL)
_X = ", ".join(f"CAST(coalesce({p}, 0.0) AS DOUBLE) AS {p}" if p == C.CIN_COL else f"CAST({p} AS DOUBLE) AS {p}" for p in C.PREDICTORS)
_boost_sql(f"SELECT feature_id AS id, CAST(ht40_km AS DOUBLE) AS y, 1.0 AS w, {_PART} AS train, {_X} FROM fe WHERE ht40_km IS NOT NULL AND {_ALL}", "bh")


def _exact(t):
    """Exact boosted trees of the echo-top height and the rows they were fitted on and held from."""
    if not hasattr(t, "_exact"):
        rows = boosting.md5_split(models.prepare_predictors(model_rows(t), "ht40_km"))
        t._exact = boosting.fit_exact(rows, "ht40_km", C.PREDICTORS, ROUNDS, DEPTH, STEP), rows
    return t._exact


register(
    "H12_exact_trees",
    lambda t: boosting.splits_of(_exact(t)[0], t.spark),
    "SELECT round, node, predictor, threshold, gain, weight FROM bh_splits",
    doubles="threshold gain weight",
    longs="round node",
    digits=4,
)
register(
    "H12_exact_r2",
    lambda t: boosting.r2(_exact(t)[1].where("NOT train"), "ht40_km", _exact(t)[0].predict({p: F.col(p) for p in C.PREDICTORS})),
    "SELECT 1 - sum(power(y - pred, 2)) / (var_pop(y) * count(*)) AS r2, count(*) AS n FROM bh WHERE NOT train",
    doubles="r2",
    longs="n",
)
# For the local effects every held-out row is also scored with the shear of either edge of its bin.
_S = C.SHEAR_COL
CTES["ale_edges"] = f"SELECT list_sort(list_distinct(quantile_cont({_S}, [{', '.join(str(i / 20) for i in range(21))}]))) AS e FROM bh_in WHERE NOT train"
CTES["ale_binned"] = f"SELECT b.*, greatest(len(list_filter(e, lambda x: x < {_S})), 1) AS k, e FROM bh_in AS b CROSS JOIN ale_edges WHERE NOT train"
_boost_sql(
    f"""SELECT *, 'own' AS side, 0 AS bin FROM bh_in
UNION ALL SELECT * EXCLUDE (k, e) REPLACE (e[k] AS {_S}), 'lo', k - 1 FROM ale_binned UNION ALL SELECT * EXCLUDE (k, e) REPLACE (e[k + 1] AS {_S}), 'hi', k - 1 FROM ale_binned""",
    "ale",
)
register(
    "H13_exact_effects",
    lambda t: models.ale(_exact(t)[0], _exact(t)[1].where("NOT train"), _S),
    """SELECT bin, lo, hi, n, local, acc - sum((acc - local / 2) * n) OVER () / sum(n) OVER () AS effect FROM (
       SELECT *, sum(local) OVER (ORDER BY bin) AS acc FROM (
         SELECT bin, e[bin + 1] AS lo, e[bin + 2] AS hi, count(*) FILTER (side = 'hi') AS n, avg(pred) FILTER (side = 'hi') - avg(pred) FILTER (side = 'lo') AS local
         FROM ale CROSS JOIN ale_edges WHERE side <> 'own' GROUP BY ALL) AS b) AS a""",
    doubles="lo hi local effect",
    longs="bin n",
)
_boost_sql(
    f"""SELECT id, y, CASE WHEN y = 1 THEN total / (2.0 * ones) ELSE total / (2.0 * (total - ones)) END AS w, train, {', '.join(C.PREDICTORS)} FROM (
    SELECT *, count(*) FILTER (train) OVER () AS total, count(*) FILTER (train AND y = 1) OVER () AS ones FROM (
      SELECT feature_id AS id, CAST(ext_pct AS DOUBLE) AS y, {_PART} AS train, {_X} FROM ext WHERE {_ALL}) AS d) AS e""",
    "bx",
)


def _extremes(t):
    """Ranking of the extremes at the 99th percentile by exact trees with balanced classes, over held-out rows."""
    rows = boosting.balanced(boosting.md5_split(models.prepare_predictors(cd.label_extremes(model_rows(t)), "ext_pct")), "ext_pct")
    model = boosting.fit_exact(rows, "ext_pct", C.PREDICTORS, ROUNDS, DEPTH, STEP, weight="weight")
    return boosting.average_precision(rows.where("NOT train"), "ext_pct", F.round(model.predict({p: F.col(p) for p in C.PREDICTORS}), 9))


register(
    "H17_exact_precision",
    _extremes,
    """SELECT sum(p / pt * pu / cu) AS pr_auc, max(pt) / max(ct) AS prevalence, max(ct) AS n FROM (
       SELECT *, sum(p) OVER o AS pu, sum(c) OVER o AS cu, sum(p) OVER () AS pt, sum(c) OVER () AS ct FROM (
         SELECT round(pred, 9) AS score, sum(y) AS p, count(*) AS c FROM bx WHERE NOT train GROUP BY 1) AS s WINDOW o AS (ORDER BY score DESC)) AS r""",
    doubles="pr_auc prevalence",
    longs="n",
)
register("H12_boosted_trees", lambda t: models.fit_gbt(fe(t), "ht40_km")[1])
register(
    "H13_local_effects",
    lambda t: models.ale(models.fit_gbt(model_rows(t), "ht40_km")[0], models.held_out(model_rows(t), "ht40_km"), C.SHEAR_COL),
)
register(
    "H14_partial_effect_linear",
    lambda t: models.partial_effect(fe(t), "ht40_km", C.SHEAR_COL, ["abs_lat"], nuisance="linear"),
    f"""SELECT ty / tt AS effect, sqrt((yy - ty / tt * ty) / (n - 1) / tt) AS std_error, n FROM (
        SELECT sum(rt * ry) AS ty, sum(rt * rt) AS tt, sum(ry * ry) AS yy, count(*) AS n FROM (
          SELECT y - (y_at + y_by * x) AS ry, t - (t_at + t_by * x) AS rt FROM folded JOIN (
            SELECT 1 - fold AS fold, regr_slope(y, x) AS y_by, regr_intercept(y, x) AS y_at, regr_slope(t, x) AS t_by, regr_intercept(t, x) AS t_at FROM folded GROUP BY 1) AS fits USING (fold)) AS r) AS m""",
    doubles="effect std_error",
    longs="n",
)
CTES["folded"] = f"""
SELECT ht40_km AS y, {C.SHEAR_COL} AS t, abs_lat AS x, CAST('0x' || substr(md5(CAST(feature_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS fold
FROM fe WHERE ht40_km IS NOT NULL AND {C.SHEAR_COL} IS NOT NULL AND abs_lat IS NOT NULL"""
register(
    "H14_partial_effect",
    lambda t: models.partial_effect(fe(t), "ht40_km", C.SHEAR_COL, ["p90_cape_2p50deg", "mean_cin_2p50deg", "mean_tpr_2p50deg", "mean_skt_2p50deg", "abs_lat"]),
)
CTES["ext"] = """
SELECT f.* REPLACE (coalesce(f.ht40_km, 0.0) AS ht40_km), t.threshold, CAST(coalesce(f.ht40_km, 0.0) >= 14 AS INT) AS ext_abs, coalesce(CAST(f.ht40_km >= t.threshold AS INT), 0) AS ext_pct
FROM fe f LEFT JOIN (SELECT surf, quantile_cont(ht40_km, 0.99) AS threshold FROM fe WHERE ht40_km > 0 GROUP BY 1) t ON t.surf = f.surf"""
register(
    "H15_extreme_prevalence",
    lambda t: cd.label_extremes(model_rows(t)).groupBy("surf").agg(F.avg("ext_abs").alias("prev_abs"), F.avg("ext_pct").alias("prev_pct"), F.max("threshold").alias("threshold"), F.count("*").alias("n")),
    "SELECT surf, avg(ext_abs) AS prev_abs, avg(ext_pct) AS prev_pct, max(threshold) AS threshold, count(*) AS n FROM ext GROUP BY 1",
    doubles="prev_abs prev_pct threshold",
    longs="n",
)
register(
    "H16_extreme_environment",
    lambda t: cd.extreme_environment(cd.label_extremes(model_rows(t))),
    " UNION ALL ".join(
        f"SELECT ext_pct AS extreme, '{p}' AS predictor, quantile_cont({p}, 0.25) AS q25, quantile_cont({p}, 0.5) AS q50, quantile_cont({p}, 0.75) AS q75, count({p}) AS n FROM ext GROUP BY 1"
        for p in C.PREDICTORS
    ),
    doubles="q25 q50 q75",
    longs="extreme n",
    digits=7,
)
register("H17_extreme_classifier", lambda t: models.fit_extreme_classifier(cd.label_extremes(model_rows(t))))
