"""Feature and member-pixel tables from labelled swaths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.scalars import encode_feature_id, int_div, is_number, surface_class, wrap_lon
from rainloom.operators import echotops
from rainloom.operators.labels import rain_mask, swath_extent
from rainloom.schemas import FEATURES, PIXELS, conform
from rainloom.session import growing, materialize

PIXEL = ["mission", "orbit", "scan", "ray"]
FEATURE = ["mission", "orbit", "local_label"]
KM_PER_DEG = math.pi * C.EARTH_RADIUS_KM / 180.0
THIN_KM = 1e-3
ASPECT_MAX = 1e4


def join_members(
    swath: DataFrame, labels: DataFrame, side: DataFrame | None = None, floors=None, echo: bool = True
) -> DataFrame:
    """Swath columns of every member pixel with its label.

    The reflectivity floor is applied before the join so that only raining pixels are
    shuffled, and the vertical arrays are reduced to echo columns on the scan side.
    ``side`` adds narrow per-pixel columns (footprint, co-located temperatures) where the
    swath does not carry them.
    """
    wet = rain_mask(swath, floors)
    if echo:
        wet = echotops.with_echo_columns(wet)
    members = labels.select(*PIXEL, "local_label")
    if side is not None:
        extra = [c for c in side.columns if c not in PIXEL]
        wet = wet.drop(*extra)
        members = members.join(growing(side), PIXEL, "left")
    return members.join(growing(wet), PIXEL)


def _present(name: str) -> Column:
    return F.when(is_number(name), F.col(name).cast("double"))


# Each group below: aggregate columns over the member pixels, and the expressions that
# turn them into output columns. They can be run alone or all in one aggregation.


def extent_aggs() -> list[Column]:
    return [
        F.count("*").alias("npixels"),
        F.sum(_present("pixel_area")).alias("area_km2"),
        F.min("scan").alias("bbox_scan_min"),
        F.max("scan").alias("bbox_scan_max"),
        F.min("ray").alias("bbox_ray_min"),
        F.max("ray").alias("bbox_ray_max"),
    ]


def time_aggs() -> list[Column]:
    # Whole seconds and microseconds are summed apart: exact, and no long overflow.
    us = F.unix_micros("time")
    sec = F.floor(us / F.lit(1_000_000)).cast("long")
    return [
        F.sum(sec).alias("_t_sec"),
        F.sum(us - sec * 1_000_000).alias("_t_us"),
        F.count("time").alias("_t_n"),
    ]


def time_cols() -> dict[str, Column]:
    n = F.when(F.col("_t_n") > 0, F.col("_t_n"))
    whole = int_div("_t_sec", n)
    rest = (F.col("_t_sec") - whole * n) * 1_000_000 + F.col("_t_us")
    return {"time": F.timestamp_micros(whole * 1_000_000 + int_div(rest, n))}


def _positioned() -> Column:
    return is_number("lat") & is_number("lon")


def centroid_aggs() -> list[Column]:
    weight = F.when(_positioned() & is_number("pixel_area") & (F.col("pixel_area") > 0), F.col("pixel_area").cast("double"))
    rad = F.radians(F.col("lon").cast("double"))
    return [
        F.sum(weight).alias("_w"),
        F.sum(weight * F.col("lat")).alias("_wlat"),
        F.sum(weight * F.cos(rad)).alias("_wx"),
        F.sum(weight * F.sin(rad)).alias("_wy"),
        F.avg(F.when(weight.isNotNull(), F.col("lon").cast("double"))).alias("_mean_lon"),
    ]


def centroid_cols() -> dict[str, Column]:
    lon = F.when((F.col("_wx") == 0) & (F.col("_wy") == 0), F.col("_mean_lon")).otherwise(
        F.degrees(F.atan2("_wy", "_wx"))
    )
    return {
        "centroid_lat": F.try_divide("_wlat", "_w"),
        "centroid_lon": F.when(F.col("_w") > 0, lon),
    }


def _lon_frames() -> tuple[Column, Column]:
    """Longitude in [-180, 180) and in [0, 360).

    A feature spanning under 180 degrees is unbroken in at least one of them, namely the
    one in which it is narrower.
    """
    west = F.when(_positioned(), wrap_lon("lon"))
    return west, F.pmod(west, F.lit(360.0))


def bbox_aggs() -> list[Column]:
    west, east = _lon_frames()
    return [
        F.min(_present("lat")).alias("bbox_lat_min"),
        F.max(_present("lat")).alias("bbox_lat_max"),
        F.min(west).alias("_west_lo"),
        F.max(west).alias("_west_hi"),
        F.min(east).alias("_east_lo"),
        F.max(east).alias("_east_hi"),
    ]


def _crosses_seam() -> Column:
    return (F.col("_east_hi") - F.col("_east_lo")) < (F.col("_west_hi") - F.col("_west_lo"))


def bbox_cols() -> dict[str, Column]:
    """Seam-aware longitude box: min > max when the feature crosses +/-180."""
    return {
        "bbox_lon_min": F.when(_crosses_seam(), wrap_lon("_east_lo")).otherwise(F.col("_west_lo")),
        "bbox_lon_max": F.when(_crosses_seam(), wrap_lon("_east_hi")).otherwise(F.col("_west_hi")),
    }


def surface_aggs() -> list[Column]:
    cls = surface_class("surface_type")
    return [F.count_if(cls == i).alias(f"_surf{i}") for i in range(3)]


def surface_cols() -> dict[str, Column]:
    ocean, land, coast = (F.col(f"_surf{i}") for i in range(3))
    known = ocean + land + coast
    flag = (
        F.when(known == 0, F.lit(-1))
        .when((ocean >= land) & (ocean >= coast), F.lit(0))
        .when(land >= coast, F.lit(1))
        .otherwise(F.lit(2))
    )
    return {
        "frac_land": F.try_divide(land, known),
        "frac_ocean": F.try_divide(ocean, known),
        "frac_coast": F.try_divide(coast, known),
        "surface_flag": flag,
    }


def rain_aggs() -> list[Column]:
    volume = _present("near_sfc_rain") * _present("pixel_area")
    return [
        F.max(_present("near_sfc_dbz")).alias("max_near_sfc_dbz"),
        F.max(_present("near_sfc_rain")).alias("max_near_sfc_rain"),
        F.avg(_present("near_sfc_rain")).alias("mean_near_sfc_rain"),
        F.sum(volume).alias("volrain_total"),
    ]


def axes_aggs() -> list[Column]:
    lat = F.when(_positioned(), F.col("lat").cast("double"))
    west, east = _lon_frames()
    return [
        F.count(lat).alias("_ax_n"),
        F.avg(lat).alias("_lat0"),
        F.var_pop(lat).alias("_vlat"),
        F.var_pop(west).alias("_vwest"),
        F.var_pop(east).alias("_veast"),
        F.covar_pop(west, lat).alias("_cwest"),
        F.covar_pop(east, lat).alias("_ceast"),
    ]


def _eigen(cxx: Column, cyy: Column, cxy: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of a symmetric 2x2 matrix, floored at zero."""
    mean = (cxx + cyy) / 2.0
    radius = F.sqrt(F.pow((cxx - cyy) / 2.0, 2) + F.pow(cxy, 2))
    return F.greatest(mean + radius, F.lit(0.0)), F.greatest(mean - radius, F.lit(0.0))


def axes_cols() -> dict[str, Column]:
    """PCA axes on a local plane in km: four standard deviations; angle from east."""
    squeeze = F.cos(F.radians("_lat0")) * KM_PER_DEG
    vlon = F.when(_crosses_seam(), F.col("_veast")).otherwise(F.col("_vwest"))
    clon = F.when(_crosses_seam(), F.col("_ceast")).otherwise(F.col("_cwest"))
    cxx, cyy, cxy = vlon * squeeze * squeeze, F.col("_vlat") * KM_PER_DEG**2, clon * squeeze * KM_PER_DEG
    big, small = _eigen(cxx, cyy, cxy)
    shaped = F.coalesce(F.col("_ax_n") >= 2, F.lit(False))
    major, minor = 4.0 * F.sqrt(big), 4.0 * F.sqrt(small)
    angle = F.when((cxy == 0) & (cxx == cyy), F.lit(90.0)).otherwise(F.degrees(0.5 * F.atan2(2.0 * cxy, cxx - cyy)))
    aspect = F.when(major <= 0, F.lit(1.0)).otherwise(
        F.least(major / F.greatest(minor, F.lit(THIN_KM)), F.lit(ASPECT_MAX))
    )
    return {
        "major_axis_km": F.when(shaped, major).otherwise(0.0),
        "minor_axis_km": F.when(shaped, minor).otherwise(0.0),
        "orientation_deg": F.when(shaped, angle).otherwise(0.0),
        "aspect_ratio": F.when(shaped, aspect).otherwise(1.0),
    }


def eccentricity_aggs() -> list[Column]:
    return [
        F.var_pop("scan").alias("_vs"),
        F.var_pop("ray").alias("_vr"),
        F.covar_pop(F.col("scan").cast("double"), F.col("ray").cast("double")).alias("_vsr"),
    ]


def eccentricity_cols() -> dict[str, Column]:
    big, small = _eigen(F.col("_vs"), F.col("_vr"), F.col("_vsr"))
    return {"eccentricity": F.when(big > 0, F.sqrt(1.0 - small / big)).otherwise(0.0)}


def thin(df: DataFrame) -> DataFrame:
    """Needs the axes and npixels."""
    flag = (
        (F.col("minor_axis_km") <= THIN_KM * (1.0 + 1e-9))
        | (F.col("aspect_ratio") >= ASPECT_MAX)
        | (F.col("npixels") <= 1)
    )
    return df.withColumn("is_thin", flag)


def pct_aggs() -> list[Column]:
    return [
        F.min(_present("pct_85_89")).alias("min_pct_85_89"),
        F.min(_present("pct_37")).alias("min_pct_37"),
    ]


def conv_strat_aggs() -> list[Column]:
    area = _present("pixel_area")
    volume = _present("near_sfc_rain") * area
    zero = F.lit(0.0)
    out = []
    for name, code in (("conv", 2), ("strat", 1)):
        mine = F.col("rain_type") == code
        out.append(F.coalesce(F.sum(F.when(mine, area)), zero).alias(f"{name}_area_km2"))
        out.append(F.coalesce(F.sum(F.when(mine, volume)), zero).alias(f"volrain_{name}"))
    return out


def conv_strat_cols() -> dict[str, Column]:
    """Shares; null where the total is absent or not positive."""
    area = F.when(F.col("area_km2") > 0, F.col("area_km2"))
    rain = F.when(F.col("volrain_total") > 0, F.col("volrain_total"))
    return {
        "conv_area_frac": F.col("conv_area_km2") / area,
        "strat_area_frac": F.col("strat_area_km2") / area,
        "conv_rain_frac": F.col("volrain_conv") / rain,
        "strat_rain_frac": F.col("volrain_strat") / rain,
    }


def height_aggs() -> list[Column]:
    return [
        F.avg(_present("bb_height")).alias("mean_bb_height"),
        F.avg(_present("freezing_level")).alias("mean_freezing_level"),
    ]


def class_cols(mcs_area: float = C.MCS_AREA_KM2) -> dict[str, Column]:
    mcs = F.col("area_km2") >= mcs_area
    return {
        "is_mcs": mcs,
        "feature_class": F.when(mcs, F.lit("MCS"))
        .when(F.col("conv_area_km2") > 0, F.lit("sub_MCS_conv"))
        .when(F.col("strat_area_km2") > 0, F.lit("stratiform_only"))
        .otherwise(F.lit("weak")),
    }


def _run(members: DataFrame, aggs: list[Column], *col_groups: dict[str, Column]) -> DataFrame:
    out = members.groupBy(*FEATURE).agg(*aggs)
    for group in col_groups:
        out = out.withColumns(group)
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def feature_extent(members: DataFrame) -> DataFrame:
    return _run(members, extent_aggs())


def feature_time(members: DataFrame) -> DataFrame:
    return _run(members, time_aggs(), time_cols())


def feature_centroid(members: DataFrame) -> DataFrame:
    return _run(members, centroid_aggs(), centroid_cols())


def feature_bbox(members: DataFrame) -> DataFrame:
    return _run(members, bbox_aggs(), bbox_cols())


def feature_surface(members: DataFrame) -> DataFrame:
    return _run(members, surface_aggs(), surface_cols())


def feature_rain(members: DataFrame) -> DataFrame:
    return _run(members, rain_aggs()).drop("volrain_total")


def feature_volume(members: DataFrame) -> DataFrame:
    return _run(members, rain_aggs()).select(*FEATURE, "volrain_total")


def feature_axes(members: DataFrame) -> DataFrame:
    return _run(members, bbox_aggs() + axes_aggs(), axes_cols()).drop("bbox_lat_min", "bbox_lat_max")


def feature_eccentricity(members: DataFrame) -> DataFrame:
    return _run(members, eccentricity_aggs(), eccentricity_cols())


def feature_thin(members: DataFrame) -> DataFrame:
    out = _run(members, extent_aggs() + bbox_aggs() + axes_aggs(), axes_cols())
    return thin(out).select(*FEATURE, "is_thin")


def feature_min_pct(members: DataFrame) -> DataFrame:
    return _run(members, pct_aggs())


def feature_conv_strat(members: DataFrame) -> DataFrame:
    cols = ["conv_area_km2", "strat_area_km2", "volrain_conv", "volrain_strat", *conv_strat_cols()]
    return _run(members, extent_aggs() + rain_aggs() + conv_strat_aggs(), conv_strat_cols()).select(*FEATURE, *cols)


def feature_heights(members: DataFrame) -> DataFrame:
    return _run(members, height_aggs())


def feature_class(members: DataFrame) -> DataFrame:
    return _run(members, extent_aggs() + conv_strat_aggs(), class_cols()).select(*FEATURE, *class_cols())


def build_features(swath: DataFrame, labels: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The 58-column feature table: one aggregation over the members, plus the peeled tops."""
    if members is None:
        members = materialize(join_members(swath, labels), "members")  # read by three aggregates
    aggs = (
        extent_aggs() + time_aggs() + centroid_aggs() + bbox_aggs() + surface_aggs() + rain_aggs()
        + axes_aggs() + eccentricity_aggs() + pct_aggs() + conv_strat_aggs() + height_aggs()
        + echotops.below_aggregates()
    )
    out = members.groupBy(*FEATURE).agg(*aggs)
    for group in (
        time_cols(), centroid_cols(), bbox_cols(), surface_cols(), axes_cols(), eccentricity_cols(),
        conv_strat_cols(), class_cols(),
    ):
        out = out.withColumns(group)
    out = thin(out)
    out = echotops.finish_tops(out.join(growing(echotops.qc_high_tops(members, swath)), FEATURE, "left"))
    at_edge = (
        (F.col("bbox_scan_min") == F.col("scan_first"))
        | (F.col("bbox_scan_max") == F.col("scan_last"))
        | (F.col("bbox_ray_min") == F.col("ray_first"))
        | (F.col("bbox_ray_max") == F.col("ray_last"))
    )
    out = out.join(growing(swath_extent(swath)), ["mission", "orbit"]).withColumns(
        {"edge": at_edge, "feature_id": encode_feature_id("mission", "orbit", "local_label")}
    )
    return conform(out, FEATURES)


def build_pixels(swath: DataFrame, labels: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The 14-column member-pixel table."""
    if members is None:
        members = join_members(swath, labels, echo=False)
    out = members.withColumns(
        {
            "feature_id": encode_feature_id("mission", "orbit", "local_label"),
            "pixel_area_km2": F.col("pixel_area"),
        }
    )
    return conform(out, PIXELS)
