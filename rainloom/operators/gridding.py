"""Grid accumulations: sampling counts, rain by storm class, per-pixel metrics.

All outputs are sparse long tables; sums and counts are kept apart to the end so that
any level pools by plain addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.operators.echotops import pixel_echo_tops
from rainloom.schemas import VIEWS, conform
from rainloom.session import growing, materialize

PIXEL = ["mission", "orbit", "scan", "ray"]
FEATURE = ["mission", "orbit", "local_label"]
CELL = ["lat_bin", "lon_bin"]
CELL_HOUR = [*CELL, "hour"]
RAIN_CLASSES = ["size_class", "echotop_class", "raintype"]


def _on_grid(df: DataFrame, deg: float) -> DataFrame:
    return df.withColumns({"lat_bin": S.lat_bin("lat", deg), "lon_bin": S.lon_bin("lon", deg)})


def _in_hour_grid(swath: DataFrame, window, deg: float) -> DataFrame:
    """Views with a valid time, binned, with their UTC hour."""
    df = swath.where(S.is_view(ts="time"))
    if window is not None:
        df = df.where(S.in_window("time", *window))
    return _on_grid(df, deg).withColumn("hour", S.utc_hour("time").cast("byte"))


# --- sampling -------------------------------------------------------------


def orbit_views(swath: DataFrame, deg: float = C.GRID_DEG) -> DataFrame:
    """Views per orbit and cell, with the mean scan time of the orbit."""
    # A scan counts once however many rays it has.
    per_scan = swath.groupBy("mission", "orbit", "scan").agg(F.max("time").alias("time"))
    us = F.unix_micros("time")
    sec = F.floor(us / F.lit(1_000_000)).cast("long")
    mean_time = (
        per_scan.groupBy("mission", "orbit")
        .agg(F.sum(sec).alias("s"), F.sum(us - sec * 1_000_000).alias("u"), F.count("time").alias("n"))
        .where("n > 0")
        .select(
            "mission",
            "orbit",
            F.timestamp_micros(
                S.int_div("s", F.col("n")) * 1_000_000
                + S.int_div(F.pmod(F.col("s"), F.col("n")) * 1_000_000 + F.col("u"), F.col("n"))
            ).alias("time"),
        )
    )
    cells = _on_grid(swath.where(S.is_view()), deg).groupBy("mission", "orbit", *CELL).agg(F.count("*").alias("n_views"))
    out = cells.join(growing(mean_time), ["mission", "orbit"], "left")
    return conform(out.withColumn("mission", F.upper("mission")), VIEWS)


def hour_views(swath: DataFrame, window=None, deg: float = C.GRID_DEG, by: tuple = ("mission",)) -> DataFrame:
    return _in_hour_grid(swath, window, deg).groupBy(*by, *CELL_HOUR).agg(F.count("*").alias("n_views"))


# --- rain by storm class --------------------------------------------------


def class_maps(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Size and echo-top class of every member pixel."""
    classes = features.select(
        *FEATURE,
        S.size_class("major_axis_km").cast("byte").alias("size_class"),
        S.echotop_class("max_ht_20dbz").cast("byte").alias("echotop_class"),
    )
    return labels.join(growing(classes), FEATURE).select(*PIXEL, "size_class", "echotop_class")


def hour_rain(
    swath: DataFrame,
    labels: DataFrame,
    features: DataFrame,
    window=None,
    deg: float = C.GRID_DEG,
    by: tuple = ("mission",),
) -> DataFrame:
    """Rain sum and count per cell, hour and storm class.

    A raining pixel outside every feature keeps its rain type and goes to the undefined
    size and echo-top class.
    """
    raining = (
        _in_hour_grid(swath, window, deg)
        .withColumn("raintype", S.raintype_class("rain_type").cast("byte"))
        .where((F.col("near_sfc_rain") > 0) & F.col("raintype").isNotNull())
        .select(*dict.fromkeys([*by, *PIXEL, *CELL_HOUR, "raintype", "near_sfc_rain"]))
    )
    undefined = F.lit(C.UNDEFINED_CLASS).cast("byte")
    classed = raining.join(growing(class_maps(labels, features)), PIXEL, "left").withColumns(
        {
            "size_class": F.coalesce("size_class", undefined),
            "echotop_class": F.coalesce("echotop_class", undefined),
        }
    )
    return classed.groupBy(*by, *CELL_HOUR, *RAIN_CLASSES).agg(
        F.sum(F.col("near_sfc_rain").cast("double")).alias("rain_sum"), F.count("*").alias("raining_count")
    )


# --- per-pixel metrics ----------------------------------------------------


def _metric_aggs() -> list[Column]:
    conv, strat = F.col("rain_type") == 2, F.col("rain_type") == 1
    out: dict[str, Column] = {}

    def pair(name: str, value: Column) -> None:
        out[f"{name}_sum"] = F.coalesce(F.sum(value), F.lit(0.0))
        out[f"{name}_n"] = F.count(value)

    for t in C.ECHO_THRESHOLDS:
        pair(f"et{t}", F.when(conv, F.col(f"top_{t}").cast("double")))
    for t in C.RAIN_THRESHOLDS:
        out[f"cnt_gt{t}"] = F.count_if(F.col("near_sfc_rain") >= t)
    for name, col in (("eps", "epsilon"), ("nw", "nw"), ("dm", "dm")):
        value = F.when(S.is_number(col), F.col(col).cast("double"))
        pair(f"{name}_conv", F.when(conv, value))
        pair(f"{name}_strat", F.when(strat, value))
    return [out[c].alias(c) for c in C.METRIC_COLS]


def hour_metrics(swath: DataFrame, window=None, deg: float = C.GRID_DEG, by: tuple = ("mission",)) -> DataFrame:
    """22 metric columns per cell and hour; rows whose counts are all zero are dropped."""
    df = _in_hour_grid(swath, window, deg)
    # Only convective columns have their echo top taken; the rest drop their arrays unread.
    narrow = [*dict.fromkeys([*by, *CELL_HOUR, "ray", "rain_type", "near_sfc_rain", "epsilon", "nw", "dm"])]
    arrays = ["dbz_bins", "height_bins", "rate_bins", "bin_mirror_image"]
    is_conv = F.col("rain_type") == 2
    gated = df.select(
        *narrow, *[F.when(is_conv, F.col(c)).alias(c) for c in arrays]
    )
    tops = pixel_echo_tops(gated)
    counts = [c for c in C.METRIC_COLS if not c.endswith("_sum")]
    some = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts])
    return tops.groupBy(*by, *CELL_HOUR).agg(*_metric_aggs()).where(some)


# --- month jobs -----------------------------------------------------------

MONTH = ("mission", "year", "month")


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("time"), "month": F.month("time")})


def grid_months(
    swath: DataFrame,
    labels: DataFrame | None,
    features: DataFrame | None,
    start=None,
    end=None,
    metrics_only: bool = False,
    deg: float = C.GRID_DEG,
) -> dict[str, DataFrame]:
    """The three month tables, each scan counted in the month of its own time."""
    window = (start, end) if start is not None else None
    dated = _with_month(swath)
    out = {"metrics": hour_metrics(dated, window, deg, MONTH)}
    if not metrics_only:
        out["views"] = hour_views(dated, window, deg, MONTH)
        out["rain"] = hour_rain(dated, labels, features, window, deg, MONTH)
    return out


def merge_partials(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Add up partial grids."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def join_pixels_features(pixels: DataFrame, features: DataFrame) -> DataFrame:
    """Member pixels with the columns of their feature needed for stratification."""
    return pixels.join(growing(features.select("feature_id", "major_axis_km", "max_ht_20dbz")), "feature_id")


def accumulate_month(
    pixels: DataFrame, features: DataFrame, month: int | None = None, deg: float = C.GRID_DEG, by: tuple = ()
) -> DataFrame:
    """Joint rain accumulator (no hour) from the stored feature and pixel tables."""
    if month is not None:
        pixels = pixels.where(F.col("month") == month)
    raining = pixels.withColumn("raintype", S.raintype_class("rain_type")).where(
        (F.col("near_sfc_rain") > 0) & F.col("raintype").isNotNull()
    )
    joined = _on_grid(join_pixels_features(raining, features), deg).withColumns(
        {"size_class": S.size_class("major_axis_km"), "echotop_class": S.echotop_class("max_ht_20dbz")}
    )
    return joined.groupBy(*by, *CELL, *RAIN_CLASSES).agg(
        F.sum(F.col("near_sfc_rain").cast("double")).alias("rain_sum"), F.count("*").alias("raining_count")
    )


def reduce_views(views: DataFrame, month: int | None = None, by: tuple = ()) -> DataFrame:
    if month is not None:
        views = views.where(F.col("month") == month)
    return views.groupBy(*by, *CELL).agg(F.sum("n_views").cast("long").alias("n_views"))


def reduce_rain_hour(rain: DataFrame, by: tuple = ("mission", "month"), deg: float = C.GRID_DEG) -> DataFrame:
    """All years of a month-of-year added up, implausible rows left out."""
    return (
        rain.where(S.sane_rain(deg))
        .groupBy(*by, *CELL_HOUR, *RAIN_CLASSES)
        .agg(F.sum("rain_sum").alias("rain_sum"), F.sum("raining_count").cast("long").alias("raining_count"))
    )


def reduce_views_hour(views: DataFrame, by: tuple = ("mission", "month"), deg: float = C.GRID_DEG) -> DataFrame:
    return views.where(S.sane_views(deg)).groupBy(*by, *CELL_HOUR).agg(F.sum("n_views").cast("long").alias("n_views"))


def reduce_metrics_hour(metrics: DataFrame, by: tuple = ("mission", "month"), deg: float = C.GRID_DEG) -> DataFrame:
    kind = {c: "double" if c.endswith("_sum") else "long" for c in C.METRIC_COLS}
    return (
        metrics.where(S.sane_metrics(deg))
        .groupBy(*by, *CELL_HOUR)
        .agg(*[F.sum(c).cast(kind[c]).alias(c) for c in C.METRIC_COLS])
    )


# --- breakdowns -----------------------------------------------------------


def marginals(joint: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Breakdown by size, echo top and rain type, each on its own: long (breakdown, class)."""
    keys = keys if keys is not None else [c for c in joint.columns if c not in (*RAIN_CLASSES, "rain_sum", "raining_count")]
    slots = F.array(
        *[
            F.struct(F.lit(name).alias("breakdown"), F.col(col).cast("int").alias("class"))
            for name, col in (("size", "size_class"), ("echotop", "echotop_class"), ("raintype", "raintype"))
        ]
    )
    # Sum the joint on its cell first would not shrink it; partial aggregation merges map-side.
    return (
        joint.select(*keys, F.explode(slots).alias("slot"), "rain_sum", "raining_count")
        .groupBy(*keys, "slot.breakdown", "slot.class")
        .agg(F.sum("rain_sum").alias("rain_sum"), F.sum("raining_count").cast("long").alias("raining_count"))
    )


def clip_band(grid: DataFrame, mission: str | None = None, band=None, deg: float = C.GRID_DEG) -> DataFrame:
    lo, hi = S.lat_clip_bins(mission, band, deg)
    return grid.where(F.col("lat_bin").between(lo, hi))


def crossproduct(joint: DataFrame, band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG) -> DataFrame:
    """The full joint inside the band, with class labels."""

    def label(col: str, names: tuple) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), F.col(col).cast("int"))

    return clip_band(joint, band=band, deg=deg).withColumns(
        {
            "size_label": label("size_class", C.SIZE_LABELS),
            "echotop_label": label("echotop_class", C.ECHOTOP_LABELS),
            "raintype_label": label("raintype", C.RAINTYPE_LABELS),
        }
    )


def cell_frame(
    spark, band=C.SHARED_LAT_CLIP, lon_range=(-180.0, 180.0), deg: float = C.GRID_DEG, slabs: dict | None = None
) -> DataFrame:
    """Every cell of a box with its centre, for every combination of slab values.

    All keys are decoded from one distributed range of numbers.
    """
    lo, hi = S.lat_clip_bins(band=band, deg=deg)
    west = max(0, round((lon_range[0] - C.GRID_LON_MIN) / deg))
    east = min(S.n_lon(deg), round((lon_range[1] - C.GRID_LON_MIN) / deg)) - 1
    width, height = east - west + 1, hi - lo + 1
    slabs = slabs or {}
    total = height * width
    rest = S.int_div("id", total)
    keys = {
        "lat_bin": (S.int_div(F.pmod(F.col("id"), F.lit(total)), width) + lo).cast("short"),
        "lon_bin": (F.pmod(F.col("id"), F.lit(width)) + west).cast("short"),
    }
    for name, values in slabs.items():
        values = list(values)
        picked = F.get(F.array(*[F.lit(v) for v in values]), F.pmod(rest, F.lit(len(values))).cast("int"))
        keys[name] = picked
        rest = S.int_div(rest, len(values))
        total *= len(values)
    cells = spark.range(total).select(*[c.alias(k) for k, c in keys.items()])
    return cells.withColumns({"lat": S.cell_lat("lat_bin", deg), "lon": S.cell_lon("lon_bin", deg)})


def densify(
    grid: DataFrame,
    values: list[str],
    slabs: dict | None = None,
    band=C.SHARED_LAT_CLIP,
    lon_range=(-180.0, 180.0),
    deg: float = C.GRID_DEG,
) -> DataFrame:
    """Zeros for the untouched cells of a box, for every value of each slab key.

    ``slabs`` lists the key values, for example ``{"month": range(1, 13), "hour": range(24)}``.
    """
    cells = cell_frame(grid.sparkSession, band, lon_range, deg, slabs)
    keys = [*(slabs or {}), *CELL]
    return cells.join(grid.select(*keys, *values), keys, "left").fillna(0, values)


def climatology(
    rain: DataFrame, views: DataFrame, metrics: DataFrame, band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG
) -> dict[str, DataFrame]:
    """All missions, months and hours on the shared grid in one pass per table; the rain is reduced once and stored."""
    joint = materialize(clip_band(reduce_rain_hour(rain, deg=deg), band=band, deg=deg), "joint")
    return {
        "rain": marginals(joint),
        "joint": joint,
        "views": clip_band(reduce_views_hour(views, deg=deg), band=band, deg=deg),
        "metrics": clip_band(reduce_metrics_hour(metrics, deg=deg), band=band, deg=deg),
    }


# --- numerator over denominator -------------------------------------------


def combine(numerator: DataFrame, views: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Every viewed key with its numerator; a missing numerator is zero."""
    values = values or [c for c in numerator.columns if c not in keys]
    return views.join(numerator.select(*keys, *values), keys, "left").fillna(0, values)


def pair_missions(grid: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Cells seen by both missions, values side by side."""

    def side(name: str, tag: str) -> DataFrame:
        return grid.where(F.col("mission") == name).select(*CELL, *[F.col(v).alias(f"{v}_{tag}") for v in values])

    return side(a, "a").join(side(b, "b"), CELL)


def value_at(
    grid: DataFrame, points: DataFrame, values: list[str], band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG
) -> DataFrame:
    """Cell values at (lat, lon) of many points; null outside the band, longitude wraps."""
    lo, hi = S.lat_clip_bins(band=band, deg=deg)
    south, north = C.GRID_LAT_MIN + (lo + 0.5) * deg, C.GRID_LAT_MIN + (hi + 0.5) * deg
    inside = (F.col("lat") >= south - deg) & (F.col("lat") <= north + deg)
    nearest = F.greatest(F.lit(lo), F.least(F.lit(hi), S.lat_bin("lat", deg).cast("int"))).cast("short")
    keyed = points.withColumns({"lat_bin": F.when(inside, nearest), "lon_bin": S.lon_bin("lon", deg)})
    return keyed.join(grid.select(*CELL, *values), CELL, "left")
