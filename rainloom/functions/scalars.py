"""Column expressions: decoding, classes, binning, predicates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainloom import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def int_div(a, b) -> Column:
    """Integer division of longs (truncating)."""
    return F.call_function("div", _c(a), b if isinstance(b, Column) else F.lit(b))


def is_number(col) -> Column:
    """Present, not NaN and finite."""
    col = _c(col).cast("double")
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def finite_or_null(col) -> Column:
    return F.when(is_number(col), _c(col))


# --- decoding -------------------------------------------------------------


def decode_fill(col, sentinels=C.FILL_SENTINELS, scale=None, offset=None, tol=C.FILL_TOLERANCE) -> Column:
    """Null out fill values of the raw number, then apply scale and offset."""
    raw = _c(col).cast("double")
    is_fill = reduce(lambda a, b: a | b, [F.abs(raw - F.lit(float(s))) <= tol for s in sentinels])
    out = F.when(~is_fill & ~F.isnan(raw), raw)
    if scale is not None:
        out = out * F.lit(float(scale))
    if offset is not None:
        out = out + F.lit(float(offset))
    return out


def decode_fill_array(col, sentinels=C.FILL_SENTINELS, scale=None, offset=None) -> Column:
    return F.transform(_c(col), lambda x: decode_fill(x, sentinels, scale, offset))


def select_band(arr, band: int = 0) -> Column:
    """Drop a trailing frequency axis: keep one band of every gate."""
    return F.transform(_c(arr), lambda gate: F.get(gate, F.lit(band)))


def gate_value(arr, gate) -> Column:
    """Array value at a per-pixel bin index; null outside the array."""
    return F.when((_c(gate) >= 0) & (_c(gate) < F.size(_c(arr))), F.get(_c(arr), _c(gate)))


def scan_time(year, month, day, hour, minute, second, millis) -> Column:
    """UTC time from split integer fields; a non-positive date part gives null."""
    ok = (_c(year) > 0) & (_c(month) > 0) & (_c(day) > 0)
    day_start = F.when(ok, F.make_timestamp(_c(year), _c(month), _c(day), F.lit(0), F.lit(0), F.lit(0)))
    micros = (
        (_c(hour).cast("long") * 3600 + _c(minute).cast("long") * 60 + _c(second).cast("long")) * 1_000_000
        + F.greatest(_c(millis).cast("long"), F.lit(0)) * 1000
    )
    return F.timestamp_micros(F.unix_micros(day_start) + micros)


def zenith_cosine(zenith) -> Column:
    z = _c(zenith).cast("double")
    return F.when(is_number(z) & (z >= 0), F.cos(F.radians(F.least(z, F.lit(89.0))))).otherwise(F.lit(1.0))


def bin_heights(zenith, n_bins: int = C.N_BINS, bin_m: float = C.BIN_SIZE_M) -> Column:
    """Vertical height of every slant-range bin, highest bin first."""
    cosine = zenith_cosine(zenith)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: (F.lit(n_bins - 1) - b) * F.lit(bin_m) * cosine
    )


def rain_type(code) -> Column:
    """Leading digit of the eight-digit precipitation code; any negative code is -1."""
    return F.when(_c(code) < 0, F.lit(-1)).otherwise(int_div(_c(code).cast("long"), 10_000_000).cast("int"))


def pct(v, h, a: float, b: float) -> Column:
    """Polarisation-corrected temperature; a missing or negative channel gives null."""
    ok = is_number(v) & is_number(h) & (_c(v) >= 0) & (_c(h) >= 0)
    return F.when(ok, F.lit(a) * _c(v) - F.lit(b) * _c(h))


# --- identifiers ----------------------------------------------------------


def mission_code(mission) -> Column:
    m = F.upper(_c(mission))
    out = F.when(F.lit(False), F.lit(0))
    for name, code in C.MISSION_CODE.items():
        out = out.when(m == name, F.lit(code))
    return out


def encode_feature_id(mission, orbit, label) -> Column:
    """Pack the feature key into one long; an out-of-range part raises."""
    code, orb, lab = mission_code(mission), _c(orbit).cast("long"), _c(label).cast("long")
    ok = code.isNotNull() & orb.between(0, C.ID_ORBIT_MULT - 1) & lab.between(1, C.ID_ORBIT_MULT - 1)
    packed = code.cast("long") * C.ID_MISSION_MULT + orb * C.ID_ORBIT_MULT + lab
    return F.when(ok, packed).otherwise(
        F.raise_error(F.concat(F.lit("feature key out of range: "), F.concat_ws("/", _c(mission), orb, lab))).cast("long")
    )


def decode_feature_id(fid) -> Column:
    """struct(mission, orbit, local_label)."""
    fid = _c(fid)
    code = int_div(fid, C.ID_MISSION_MULT)
    name = F.when(F.lit(False), F.lit(""))
    for mission, value in C.MISSION_CODE.items():
        name = name.when(code == value, F.lit(mission))
    name = name.otherwise(F.raise_error(F.concat(F.lit("unknown mission in feature id "), fid.cast("string"))))
    return F.struct(
        name.alias("mission"),
        int_div(F.pmod(fid, F.lit(C.ID_MISSION_MULT)), C.ID_ORBIT_MULT).cast("int").alias("orbit"),
        F.pmod(fid, F.lit(C.ID_ORBIT_MULT)).cast("int").alias("local_label"),
    )


def has_flag(flags, bit: int) -> Column:
    return _c(flags).cast("int").bitwiseAND(F.lit(bit)) != 0


# --- classes --------------------------------------------------------------


def surface_class(code) -> Column:
    """0 ocean (0-99), 1 land (100-199), 2 coast (200 and above), -1 unknown."""
    code = _c(code)
    return (
        F.when(code.isNull() | (code < 0), F.lit(-1)).when(code < 100, F.lit(0)).when(code < 200, F.lit(1)).otherwise(F.lit(2))
    )


def edge_class(value, edges) -> Column:
    """Index of the left-closed class; missing or infinite goes to the undefined slot."""
    value = _c(value).cast("double")
    out = F.when(~is_number(value), F.lit(len(edges) + 1))
    for i, edge in enumerate(edges):
        out = out.when(value < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def size_class(km, edges=C.SIZE_EDGES_KM) -> Column:
    return edge_class(km, edges)


def echotop_class(metres, edges=C.ECHOTOP_EDGES_KM) -> Column:
    return edge_class(_c(metres).cast("double") / 1000.0, edges)


def raintype_class(code) -> Column:
    """1, 2, 3 -> 0, 1, 2; anything else is null (dropped)."""
    return F.when(_c(code).isin(1, 2, 3), _c(code).cast("int") - 1)


# --- grid -----------------------------------------------------------------


def n_lat(deg: float) -> int:
    return round(180 / deg)


def n_lon(deg: float) -> int:
    return round(360 / deg)


def _clip_bin(raw: Column, count: int) -> Column:
    """Into 0 .. count - 1; a missing position has no bin."""
    return F.when(raw.isNotNull(), F.greatest(F.lit(0), F.least(raw, F.lit(count - 1)))).cast("short")


def lat_bin(lat, deg: float = C.GRID_DEG) -> Column:
    raw = F.floor((_c(lat).cast("double") - F.lit(C.GRID_LAT_MIN)) / F.lit(deg))
    return _clip_bin(raw, n_lat(deg))


def lon_bin(lon, deg: float = C.GRID_DEG) -> Column:
    lon0 = F.lit(C.GRID_LON_MIN)
    wrapped = F.pmod(_c(lon).cast("double") - lon0, F.lit(360.0)) + lon0
    raw = F.floor((wrapped - lon0) / F.lit(deg))
    return _clip_bin(raw, n_lon(deg))


def cell_lat(bin_col, deg: float = C.GRID_DEG) -> Column:
    return F.lit(C.GRID_LAT_MIN) + (_c(bin_col) + 0.5) * F.lit(deg)


def cell_lon(bin_col, deg: float = C.GRID_DEG) -> Column:
    return F.lit(C.GRID_LON_MIN) + (_c(bin_col) + 0.5) * F.lit(deg)


def lat_clip_bins(mission: str | None = None, band=None, deg: float = C.GRID_DEG) -> tuple[int, int]:
    """Inclusive latitude-bin range of an explicit band or of a mission's coverage."""
    lo_deg, hi_deg = band if band is not None else C.LAT_CLIP.get((mission or "").upper(), (-90.0, 90.0))
    lo = math.floor((lo_deg - C.GRID_LAT_MIN) / deg)
    hi = math.floor((hi_deg - C.GRID_LAT_MIN) / deg)
    return max(0, lo), min(n_lat(deg) - 1, hi)


def utc_hour(ts) -> Column:
    return F.hour(_c(ts))


def is_view(lat="lat", lon="lon", rain="near_sfc_rain", ts=None) -> Column:
    """An observation: position and rain are present (zero rain counts)."""
    ok = is_number(lat) & is_number(lon) & is_number(rain)
    return ok & _c(ts).isNotNull() if ts is not None else ok


def in_window(ts, start, end) -> Column:
    """Half-open [start, end)."""
    return (_c(ts) >= F.lit(start).cast("timestamp")) & (_c(ts) < F.lit(end).cast("timestamp"))


def _key_range(deg: float) -> Column:
    return (
        F.col("lat_bin").between(0, n_lat(deg) - 1)
        & F.col("lon_bin").between(0, n_lon(deg) - 1)
        & F.col("hour").between(0, 23)
    )


def sane_views(deg: float = C.GRID_DEG) -> Column:
    return (F.col("n_views") > 0) & (F.col("n_views") < C.SANE_COUNT) & _key_range(deg)


def sane_rain(deg: float = C.GRID_DEG) -> Column:
    s = F.col("rain_sum")
    return (
        (F.col("raining_count") > 0)
        & (F.col("raining_count") < C.SANE_COUNT)
        & is_number(s)
        & (s >= 0)
        & (s < C.SANE_SUM)
        & _key_range(deg)
        & F.col("size_class").between(0, 4)
        & F.col("echotop_class").between(0, 4)
        & F.col("raintype").between(0, 2)
    )


def sane_metrics(deg: float = C.GRID_DEG) -> Column:
    return _key_range(deg)


# --- geography ------------------------------------------------------------


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_c(x).cast("double") for x in (lat1, lon1, lat2, lon2))
    half_dlat = F.radians(lat2 - lat1) / 2.0
    half_dlon = F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    # greatest and least skip nulls, so a missing position has to be kept missing here
    clipped = F.when(a.isNotNull(), F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))
    return F.lit(2.0 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt(clipped))


def wrap_lon(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon).cast("double") + 180.0, F.lit(360.0)) - 180.0


def population(ocean="frac_ocean", land="frac_land") -> Column:
    return F.when(_c(ocean) >= 0.5, F.lit("ocean")).when(_c(land) >= 0.5, F.lit("land")).otherwise(F.lit("coast"))


def local_solar_hour(ts, lon) -> Column:
    hours = F.hour(_c(ts)) + F.minute(_c(ts)) / 60.0 + _c(lon).cast("double") / 15.0
    return F.pmod(F.floor(hours), F.lit(24)).cast("int")


def local_hour_of_cell(hour, lon) -> Column:
    """Grid form: whole-hour shift by the rounded (half-even) longitude / 15."""
    return F.pmod(_c(hour).cast("int") + F.bround(_c(lon) / 15.0).cast("int"), F.lit(24)).cast("int")


def convective(ht30="ht30_km", conv_area="conv_area_km2") -> Column:
    return F.coalesce(_c(ht30) > 0, F.lit(False)) | F.coalesce(_c(conv_area) > 0, F.lit(False))


def is_extreme_abs(ht40="ht40_km", ht30="ht30_km", pct37="min_pct_37", pct85="min_pct_85_89") -> Column:
    """struct of the four absolute cuts; a missing value is not extreme."""
    cuts = {
        "ht40": _c(ht40) >= 14.0,
        "ht30": _c(ht30) >= 16.0,
        "pct37": _c(pct37) <= 150.0,
        "pct85": _c(pct85) <= 100.0,
    }
    return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in cuts.items()])


def nearest_hour(ts) -> Column:
    """Nearest whole hour; exactly half past goes to the even hour."""
    us = F.unix_micros(_c(ts))
    hour = F.floor(us / F.lit(3_600_000_000)).cast("long")
    rest = us - hour * F.lit(3_600_000_000)
    half = F.lit(1_800_000_000)
    up = (rest > half) | ((rest == half) & (F.pmod(hour, F.lit(2)) == 1))
    return F.timestamp_seconds((hour + up.cast("long")) * 3600)
