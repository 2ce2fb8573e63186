"""Fixed column order and types of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom import constants as C


_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "short": T.ShortType(),
    "byte": T.ByteType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(columns: str) -> T.StructType:
    """"name type, name type" to a schema, without needing a session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SWATH = _schema(
    """mission string, orbit int, scan int, ray int, lat float, lon float, time timestamp,
    pixel_area float, near_sfc_dbz float, near_sfc_rain float, rain_type int, surface_type int,
    epsilon float, nw float, dm float, bb_height float, freezing_level float, storm_top float,
    pia float, local_zenith float, pct_85_89 float, pct_37 float,
    dbz_bins array<float>, height_bins array<float>, rate_bins array<float>, bin_mirror_image int"""
)

FEATURES = _schema(
    """feature_id long, mission string, orbit int, local_label int, time timestamp, npixels int,
    area_km2 float, centroid_lat float, centroid_lon float,
    bbox_scan_min int, bbox_scan_max int, bbox_ray_min int, bbox_ray_max int,
    bbox_lat_min float, bbox_lat_max float, bbox_lon_min float, bbox_lon_max float,
    frac_land float, frac_ocean float, frac_coast float, surface_flag byte,
    max_near_sfc_dbz float, max_near_sfc_rain float, mean_near_sfc_rain float,
    max_ht_20dbz float, max_ht_30dbz float, max_ht_40dbz float,
    max_ht_20dbz_scan int, max_ht_20dbz_ray int, max_ht_30dbz_scan int, max_ht_30dbz_ray int,
    max_ht_40dbz_scan int, max_ht_40dbz_ray int,
    echotop_qc_flags short, max_ht_20dbz_censored boolean, ray_obs_ceiling_m float,
    volrain_total float, major_axis_km float, minor_axis_km float, orientation_deg float,
    aspect_ratio float, eccentricity float, is_thin boolean, edge boolean,
    min_pct_85_89 float, min_pct_37 float, conv_area_km2 float, strat_area_km2 float,
    conv_area_frac float, strat_area_frac float, conv_rain_frac float, strat_rain_frac float,
    volrain_conv float, volrain_strat float, mean_bb_height float, mean_freezing_level float,
    is_mcs boolean, feature_class string"""
)

PIXELS = _schema(
    """feature_id long, mission string, orbit int, scan int, ray short, lat float, lon float,
    near_sfc_dbz float, near_sfc_rain float, pct_85_89 float, pct_37 float, rain_type byte,
    pixel_area_km2 float, bb_height float"""
)

VIEWS = _schema("lat_bin short, lon_bin short, n_views int, mission string, orbit int, time timestamp")
GRID_VIEWS = _schema("lat_bin short, lon_bin short, hour byte, n_views long")
GRID_RAIN = _schema(
    """lat_bin short, lon_bin short, hour byte, size_class byte, echotop_class byte, raintype byte,
    rain_sum double, raining_count long"""
)
GRID_METRICS = _schema(
    "lat_bin short, lon_bin short, hour byte, "
    + ", ".join(f"{c} {'double' if c.endswith('_sum') else 'long'}" for c in C.METRIC_COLS)
)


def env_columns() -> list[str]:
    """Value columns in order: centroid per variable, then variable x box x statistic."""
    out = [f"{v}_centroid" for v in C.ENV_VARS]
    out += [f"{s}_{v}_{b}" for v in C.ENV_VARS for b in C.ENV_BOXES for s in C.ENV_STATS]
    return out


ENV = T.StructType(
    _schema("feature_id long, mission string, orbit int, time timestamp").fields
    + [T.StructField(c, T.FloatType()) for c in env_columns()]
)


def conform(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Select ``schema`` in order with casts; NaN becomes null and absent columns are null."""
    cols = []
    for field in schema.fields:
        if field.name not in df.columns:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        col = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            col = F.when(~F.isnan(col), col)
        cols.append(col.alias(field.name))
    return df.select(*cols, *extra)
