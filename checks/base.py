"""Registration of queries and the shared SQL building blocks of their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom.testbed import Inputs, inputs


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    swaps: list[str]

    @property
    def sql(self) -> str | None:
        """The whole statement with the CTEs it needs, or None for a rows-only query."""
        if self.body is None:
            return None
        used = needed(self.body)
        ctes = "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in used) + "\n" if used else ""
        replace = f" REPLACE ({', '.join(self.swaps)})" if self.swaps else ""
        return f"{ctes}SELECT *{replace} FROM (\n{self.body.strip()}\n) AS result"


REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int, special: dict[str, int]) -> DataFrame:
    """Comparable types: long, double (rounded), string, boolean; times as microseconds."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = F.unix_micros(c.cast("timestamp"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(
    name: str,
    fn: Callable[[Inputs], DataFrame],
    sql: str | None = None,
    doubles: str = "",
    longs: str = "",
    digits: int = 6,
    single: bool = False,
    **special: int,
) -> None:
    """Add a query; ``doubles`` / ``longs`` name the columns the oracle rounds / casts.

    ``single`` takes the oracle's values through single precision, as stored tables do.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(inputs(spark, sf_dir)), digits, special)

    assert name not in REGISTRY, name
    swaps = []
    for c in doubles.split():
        x = f32(c) if single else f"CAST({c} AS DOUBLE)"
        swaps.append(f"round({x}, {special.get(c, digits)}) + 0.0 AS {c}")
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    REGISTRY[name] = Query(run, sql, swaps)


CTES: dict[str, str] = {}


def needed(sql: str) -> list[str]:
    """CTEs mentioned by ``sql``, dependencies first."""
    out: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for name, body in CTES.items():
            if name != me and name not in out and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body, name)
                if name not in out:
                    out.append(name)

    visit(sql, None)
    return out


# --- SQL snippets ---------------------------------------------------------


def f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def latbin(lat: str, deg: float) -> str:
    n = round(180 / deg)
    return f"CAST(greatest(0, least({n - 1}, floor((CAST({lat} AS DOUBLE) + 90.0) / CAST({deg} AS DOUBLE)))) AS BIGINT)"


def lonbin(lon: str, deg: float) -> str:
    n = round(360 / deg)
    x = f"(CAST({lon} AS DOUBLE) + 180.0)"
    wrapped = f"(({x} - floor({x} / 360.0) * 360.0 - 180.0) + 180.0)"
    return f"CAST(greatest(0, least({n - 1}, floor({wrapped} / CAST({deg} AS DOUBLE)))) AS BIGINT)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(12742.0 * asin(sqrt(least(1.0, greatest(0.0, power(sin(radians({c} - {a}) / 2), 2)"
        f" + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))))"
    )


def edge_case(x: str, edges: tuple) -> str:
    whens = " ".join(f"WHEN {x} < {e} THEN {i}" for i, e in enumerate(edges))
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {len(edges) + 1} {whens} ELSE {len(edges)} END)"


def size_case(x: str) -> str:
    return edge_case(x, (20.0, 50.0, 100.0))


def echo_case(x: str) -> str:
    return edge_case(f"({x} / 1000.0)", (5.0, 7.5, 12.0))


def floor_div(a: str, w: float) -> str:
    return f"CAST(floor({a} / CAST({w} AS DOUBLE)) AS BIGINT)"


POP = "CASE WHEN frac_ocean >= 0.5 THEN 'ocean' WHEN frac_land >= 0.5 THEN 'land' ELSE 'coast' END"
RT = "CASE WHEN rain_type IN (1, 2, 3) THEN rain_type - 1 END"
CELLHOUR = "lat_bin, lon_bin, hour"

# Radar pixels from events; float columns carry single precision.
CTES["px0"] = """
SELECT event_id AS e, CAST(round(value * 100) AS BIGINT) AS v, user_id, event_type,
       date_trunc('year', ts) AS year0, event_id // 2450 AS orbit, (event_id % 2450) // 49 AS scan, event_id % 49 AS ray
FROM events"""
CTES["px1"] = """
SELECT *, CASE WHEN orbit % 2 = 0 THEN 'GPM' ELSE 'TRMM' END AS mission,
       CASE (orbit // 2) % 3 WHEN 0 THEN 4 WHEN 1 THEN -12 ELSE 31 END * 1000 + scan * 40 + 13 AS lat_milli,
       CASE (orbit // 2) % 3 WHEN 0 THEN 10 WHEN 1 THEN 178 ELSE -91 END * 1000 + ray * 40 + 13 AS lon_milli
FROM px0"""
CTES["px"] = f"""
SELECT mission, orbit, scan, ray, e, v,
       CAST(lat_milli AS DOUBLE) / 1000.0 AS latd,
       CAST(CASE WHEN lon_milli >= 180000 THEN lon_milli - 360000 ELSE lon_milli END AS DOUBLE) / 1000.0 AS lond,
       {f32("CAST(lat_milli AS DOUBLE) / 1000.0")} AS lat,
       {f32("CAST(CASE WHEN lon_milli >= 180000 THEN lon_milli - 360000 ELSE lon_milli END AS DOUBLE) / 1000.0")} AS lon,
       make_timestamp(epoch_us(CAST(year0 AS TIMESTAMP)) - 2400000000 + orbit * 867600000000 + scan * 97000000) AS time,
       {f32("CASE WHEN v % 97 <> 0 THEN CAST(least(v - 4800, 6000) AS DOUBLE) / 100.0 END")} AS near_sfc_dbz,
       {f32("CASE WHEN v % 50 = 7 THEN NULL WHEN v < 2000 THEN 0.0 ELSE CAST(v AS DOUBLE) / 400.0 END")} AS near_sfc_rain,
       CASE WHEN event_type IN ('view', 'purchase') THEN 1 WHEN event_type IN ('click', 'error') THEN 2
            WHEN v % 2 = 0 THEN 3 ELSE -1 END AS rain_type,
       (user_id % 21) * 20 - 20 AS surface_type,
       {f32("CASE WHEN v % 11 <> 3 THEN CAST(80 + v % 41 AS DOUBLE) / 100.0 END")} AS epsilon,
       {f32("CASE WHEN v % 13 <> 5 THEN CAST(120 + v % 53 AS DOUBLE) / 4.0 END")} AS nw,
       {f32("CASE WHEN v % 17 <> 2 THEN CAST(18 + v % 29 AS DOUBLE) / 20.0 END")} AS dm,
       CASE WHEN v % 3 = 0 THEN CAST(4000 + (e % 13) * 50 AS DOUBLE) END AS bb_height,
       CAST(4500 + (e % 7) * 100 AS DOUBLE) AS freezing_level,
       CASE WHEN v % 19 <> 4 THEN CAST(2000 + (v * 3) % 13700 AS DOUBLE) END AS storm_top,
       {f32("CAST(v % 100 AS DOUBLE) / 100.0")} AS pia,
       abs(ray - 24) * 0.75 AS local_zenith,
       least(v // 200, 150) AS top_j,
       CASE WHEN v % 5 = 0 THEN 40 + v % 20 ELSE -9999 END AS mirror
FROM px1"""
CTES["spacing"] = f"""
SELECT p.*, lag(scan) OVER s = scan - 1 AS has_prev, lead(scan) OVER s = scan + 1 AS has_next,
       {hav("lag(latd) OVER s", "lag(lond) OVER s", "latd", "lond")} AS d_prev,
       {hav("latd", "lond", "lead(latd) OVER s", "lead(lond) OVER s")} AS d_next,
       lag(ray) OVER r = ray - 1 AS has_left, lead(ray) OVER r = ray + 1 AS has_right,
       {hav("lag(latd) OVER r", "lag(lond) OVER r", "latd", "lond")} AS d_left,
       {hav("latd", "lond", "lead(latd) OVER r", "lead(lond) OVER r")} AS d_right
FROM px p WINDOW s AS (PARTITION BY mission, orbit, ray ORDER BY scan), r AS (PARTITION BY mission, orbit, scan ORDER BY ray)"""
CTES["pa"] = f"""
SELECT mission, orbit, scan, ray, e, v, latd, lond, lat, lon, time, near_sfc_dbz, near_sfc_rain, rain_type, surface_type,
       epsilon, nw, dm, bb_height, freezing_level, storm_top, pia, local_zenith, top_j, mirror,
       {f32('''(CASE WHEN has_prev AND has_next THEN 0.5 * (d_prev + d_next) WHEN has_prev THEN d_prev WHEN has_next THEN d_next END)
       * (CASE WHEN has_left AND has_right THEN 0.5 * (d_left + d_right) WHEN has_left THEN d_left WHEN has_right THEN d_right END)''')}
       AS pixel_area
FROM spacing"""
# Connected components on runs.
CTES["wet"] = """
SELECT mission, orbit, scan, ray,
       ray - row_number() OVER (PARTITION BY mission, orbit, scan ORDER BY ray) AS island
FROM px WHERE near_sfc_dbz >= CASE mission WHEN 'GPM' THEN 12.0 ELSE 16.0 END"""
CTES["runs"] = """
SELECT mission, orbit, scan, min(ray) AS r0, max(ray) AS r1, scan * 4096 + min(ray) AS run
FROM wet GROUP BY mission, orbit, scan, island"""
CTES["touch"] = """
SELECT a.mission, a.orbit, a.run AS a, b.run AS b FROM runs a JOIN runs b
  ON a.mission = b.mission AND a.orbit = b.orbit AND abs(a.scan - b.scan) = 1 AND a.r0 <= b.r1 + 1 AND b.r0 <= a.r1 + 1"""
CTES["reach"] = """
SELECT mission, orbit, run, run AS root FROM runs
UNION
SELECT t.mission, t.orbit, t.b AS run, reach.root FROM reach JOIN touch t
  ON t.mission = reach.mission AND t.orbit = reach.orbit AND t.a = reach.run WHERE reach.root < t.b"""
CTES["rooted"] = "SELECT mission, orbit, run, min(root) AS root FROM reach GROUP BY mission, orbit, run"
CTES["lab"] = """
SELECT r.mission, r.orbit, r.scan, unnest(range(r.r0, r.r1 + 1)) AS ray, n.local_label
FROM runs r JOIN rooted t ON r.mission = t.mission AND r.orbit = t.orbit AND r.run = t.run
JOIN (SELECT mission, orbit, root, row_number() OVER (PARTITION BY mission, orbit ORDER BY root) AS local_label
      FROM (SELECT DISTINCT mission, orbit, root FROM rooted)) n
  ON n.mission = t.mission AND n.orbit = t.orbit AND n.root = t.root"""
CTES["mem"] = """
SELECT pa.*, lab.local_label FROM lab JOIN pa
  ON lab.mission = pa.mission AND lab.orbit = pa.orbit AND lab.scan = pa.scan AND lab.ray = pa.ray"""

_T = "CAST(round(o_totalprice * 100) AS BIGINT)"
CTES["cat0"] = f"""
SELECT *, (t % 601) AS x FROM (
  SELECT o_orderkey AS k, o_custkey AS c, {_T} AS t, CAST(o_orderdate AS TIMESTAMP) AS o_date FROM orders)"""
CTES["cat1"] = """
SELECT k, c, t, CASE WHEN k % 3 = 0 THEN 'TRMM' ELSE 'GPM' END AS mission, k // 1000 AS orbit, k % 1000 + 1 AS local_label,
       CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END * 10000000000000 + (k // 1000) * 100000 + k % 1000 + 1 AS feature_id,
       make_timestamp(epoch_us(o_date) + (t % 1440) * 60000000) AS time, t % 97 + 1 AS npixels,
       CAST(x * x + 100 AS DOUBLE) / 100.0 AS area_km2,
       CAST((t * 7) % 8000 AS DOUBLE) / 100.0 - 40.0 + 0.003 AS centroid_lat,
       CAST((t * 13) % 36000 AS DOUBLE) / 100.0 - 180.0 + 0.003 AS centroid_lon,
       CAST((t // 7) % 600 AS DOUBLE) / 20.0 AS rate,
       CASE WHEN k % 53 <> 0 THEN CAST(k % 11 AS DOUBLE) / 10.0 END AS frac_ocean,
       CASE WHEN k % 53 <> 0 THEN CAST((10 - k % 11) * (k % 3) AS DOUBLE) / 20.0 END AS frac_land,
       CASE WHEN k % 29 <> 0 THEN CAST(2000 + (t % 180) * 100 AS DOUBLE) END AS max_ht_20dbz,
       CAST(x AS DOUBLE) / 4.0 AS major_axis_km,
       CASE WHEN k % 17 <> 0 THEN CAST(800 + (t // 11) % 2200 AS DOUBLE) / 10.0 END AS min_pct_85_89,
       CASE WHEN k % 19 <> 0 THEN CAST(1400 + (t // 13) % 1400 AS DOUBLE) / 10.0 END AS min_pct_37,
       CAST((x * x + 100) * (c % 11) AS DOUBLE) / 2000.0 AS conv_area_km2,
       CAST((x * x + 100) * (10 - c % 11) AS DOUBLE) / 2000.0 AS strat_area_km2,
       CASE WHEN k % 31 <> 0 THEN CAST((t // 3) % 55000 AS DOUBLE) / 10.0 END AS p90_cape_2p50deg,
       CAST((c * 31 + t // 5) % 3300 AS DOUBLE) / 100.0 AS shear_6000m_centroid,
       CAST((c * 17 + t // 9) % 2100 AS DOUBLE) / 100.0 AS shear_3000m_centroid,
       CAST((c * 7 + t // 15) % 900 AS DOUBLE) / 100.0 AS shear_1000m_centroid,
       CASE WHEN k % 7 <> 0 THEN -CAST(t % 300 AS DOUBLE) / 2.0 END AS mean_cin_2p50deg,
       CAST((t // 17) % 100 AS DOUBLE) / 10000.0 AS mean_tpr_2p50deg,
       CAST(2800 + (t // 19) % 300 AS DOUBLE) / 10.0 AS mean_skt_2p50deg
FROM cat0"""
CTES["cat"] = """
SELECT *, area_km2 >= 2000.0 AS is_mcs,
       CASE WHEN area_km2 >= 2000.0 THEN 'MCS' WHEN conv_area_km2 > 0 THEN 'sub_MCS_conv'
            WHEN strat_area_km2 > 0 THEN 'stratiform_only' ELSE 'weak' END AS feature_class,
       CASE WHEN k % 5 <> 0 THEN max_ht_20dbz - 1000.0 - (c % 10) * 100.0 END AS max_ht_30dbz,
       CASE WHEN (k // 3) % 3 <> 0 THEN max_ht_20dbz - 1500.0 - (c % 20) * 25.0 END AS max_ht_40dbz,
       area_km2 * rate AS volrain_total,
       area_km2 * rate * (CAST(c % 11 AS DOUBLE) / 10.0) AS volrain_conv,
       area_km2 * rate * (CAST(10 - c % 11 AS DOUBLE) / 10.0) * CAST(0.9 AS DOUBLE) AS volrain_strat
FROM cat1"""
CTES["fe"] = f"""
SELECT *, {POP} AS surf, abs(centroid_lat) AS abs_lat, max_ht_20dbz / 1000.0 AS ht20_km, max_ht_30dbz / 1000.0 AS ht30_km,
       max_ht_40dbz / 1000.0 AS ht40_km, (max_ht_30dbz / 1000.0 > 0 OR conv_area_km2 > 0) IS TRUE AS is_conv
FROM cat WHERE abs(centroid_lat) < 40"""
CTES["pix0"] = """
SELECT l_orderkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS q,
       l_partkey AS pk, l_suppkey AS sk, CAST(l_shipdate AS TIMESTAMP) AS ship FROM lineitem"""
CTES["pix"] = """
SELECT CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END * 10000000000000 + (k // 1000) * 100000 + k % 1000 + 1 AS feature_id,
       CASE WHEN k % 3 = 0 THEN 'TRMM' ELSE 'GPM' END AS mission, k // 1000 AS orbit, k % 1000 + 1 AS local_label,
       pk AS scan, sk % 49 AS ray,
       CAST(p % 4000 AS DOUBLE) / 100.0 - 20.0 + 0.003 AS lat,
       CAST((p // 7) % 12000 AS DOUBLE) / 100.0 - 60.0 + 0.003 AS lon,
       make_timestamp(epoch_us(ship) + (p % 1440) * 60000000) AS time,
       CASE WHEN q = 13 THEN NULL WHEN q % 4 = 0 THEN 0.0 ELSE CAST((p // 11) % 5000 AS DOUBLE) / 40.0 END AS near_sfc_rain,
       CASE q % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE -1 END AS rain_type
FROM pix0"""
