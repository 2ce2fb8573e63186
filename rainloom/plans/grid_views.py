"""Analyses of the sparse climatology.

Inputs: ``rain`` with breakdown classes (``class``), ``views``; keys mission / month / hour /
lat_bin / lon_bin as far as present. ``deg`` is the cell size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.functions.ranking import argmax_by
from rainloom.operators.gridding import clip_band, pair_missions

CELL = ["lat_bin", "lon_bin"]


def _area_weight(deg: float) -> Column:
    return F.cos(F.radians(S.cell_lat("lat_bin", deg)))


def _stack(rain: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of rain_sum, raining_count and n_views per key in one aggregation."""
    both = rain.select(*keys, "rain_sum", "raining_count").unionByName(
        views.select(*keys, "n_views"), allowMissingColumns=True
    )
    return both.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rain_sum", "raining_count", "n_views")]
    )


def _rate(min_views: int) -> Column:
    return F.when(F.col("n_views") >= min_views, F.try_divide("rain_sum", "n_views"))


def _with_classes(seen: DataFrame, rain: DataFrame, breakdown: str) -> DataFrame:
    """Every viewed key with each class of the breakdown, whether or not it rains in any."""
    classes = F.array(*[F.lit(c) for c in range(len(C.BREAKDOWNS[breakdown]))])
    return seen.withColumn("class", F.explode(classes.cast(f"array<{dict(rain.dtypes)['class']}>")))


def coarsen(
    grid: DataFrame, factor: int, values: list[str], band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG, keys: tuple = ()
) -> DataFrame:
    """Block sums from the south-west corner of the band; a trailing partial block is cut off."""
    lo, hi = S.lat_clip_bins(band=band, deg=deg)
    n_rows, n_cols = (hi - lo + 1) // factor, S.n_lon(deg) // factor
    row = F.floor((F.col("lat_bin") - lo) / factor).cast("int")
    col = F.floor(F.col("lon_bin") / factor).cast("int")
    return (
        grid.where(F.col("lat_bin").between(lo, lo + n_rows * factor - 1) & (F.col("lon_bin") < n_cols * factor))
        .groupBy(*keys, row.alias("row"), col.alias("col"))
        .agg(*[F.sum(v).alias(v) for v in values])
        .withColumns(
            {
                "lat": C.GRID_LAT_MIN + (lo + (F.col("row") + 0.5) * factor) * F.lit(deg),
                "lon": C.GRID_LON_MIN + (F.col("col") + 0.5) * factor * F.lit(deg),
            }
        )
    )


def pyramid(
    grid: DataFrame, factors: tuple, values: list[str], band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG, keys: tuple = ()
) -> DataFrame:
    """Block sums at several factors in one pass: each cell is sent to its block of every level."""
    lo, hi = S.lat_clip_bins(band=band, deg=deg)
    n_rows, n_cols = hi - lo + 1, S.n_lon(deg)

    def block(f: int) -> Column:
        whole = (F.col("lat_bin") < lo + n_rows // f * f) & (F.col("lon_bin") < n_cols // f * f)
        return F.when(
            whole,
            F.struct(
                F.lit(f).alias("factor"),
                F.floor((F.col("lat_bin") - lo) / f).cast("int").alias("row"),
                F.floor(F.col("lon_bin") / f).cast("int").alias("col"),
            ),
        )

    levels = F.explode(F.array_compact(F.array(*[block(f) for f in factors])))
    return (
        grid.where(F.col("lat_bin").between(lo, hi))
        .select(*keys, levels.alias("b"), *values)
        .groupBy(*keys, "b.factor", "b.row", "b.col")
        .agg(*[F.sum(v).alias(v) for v in values])
    )


def seasonal_cycle(rain: DataFrame, views: DataFrame, band=(-30.0, 30.0), deg: float = C.GRID_DEG, by: tuple = (), breakdown: str = "size") -> DataFrame:
    """Area-mean rate and frequency per month and class: weighted sums over weighted views.

    A viewed month without rain of a class has the rate zero.
    """
    w = _area_weight(deg)
    top = clip_band(rain, band=band, deg=deg).groupBy(*by, "month", "class").agg(
        F.sum(w * F.col("rain_sum")).alias("r"), F.sum(w * F.col("raining_count")).alias("c")
    )
    bottom = clip_band(views, band=band, deg=deg).groupBy(*by, "month").agg(F.sum(w * F.col("n_views")).alias("v"))
    zero = F.lit(0.0)
    return _with_classes(bottom, rain, breakdown).join(top, [*by, "month", "class"], "left").select(
        *by, "month", "class", F.try_divide(F.coalesce("r", zero), "v").alias("rate"), F.try_divide(F.coalesce("c", zero), "v").alias("freq")
    )


def diurnal_cycle_lst(
    rain: DataFrame, views: DataFrame, band=(-30.0, 30.0), deg: float = C.GRID_DEG, min_views: int = 5, breakdown: str = "size"
) -> DataFrame:
    """Weighted mean of the cell rates per local solar hour and class.

    A well-viewed cell without rain of the class counts with rate zero, and so does an hour without any.
    """
    keys = [*CELL, "hour"]
    seen = (
        clip_band(views, band=band, deg=deg).groupBy(*keys).agg(F.sum("n_views").alias("n_views")).where(F.col("n_views") >= min_views)
    )
    wet = clip_band(rain, band=band, deg=deg).groupBy(*keys, "class").agg(F.sum("rain_sum").alias("rain_sum"))
    lst = S.local_hour_of_cell("hour", S.cell_lon("lon_bin", deg))
    w = _area_weight(deg)
    weights = seen.groupBy(lst.alias("lst")).agg(F.sum(w).alias("w"))
    rates = wet.join(seen, keys).groupBy(lst.alias("lst"), "class").agg(
        F.sum(w * F.col("rain_sum") / F.col("n_views")).alias("wr")
    )
    # at most 24 hours by a handful of classes
    return _with_classes(weights, rain, breakdown).join(F.broadcast(rates), ["lst", "class"], "left").select(
        "lst", "class", F.try_divide(F.coalesce("wr", F.lit(0.0)), "w").alias("rate")
    )


def peak_hour_map(
    rain: DataFrame, views: DataFrame, deg: float = C.GRID_DEG, min_views: int = 5, min_rain: float = 0.02
) -> DataFrame:
    """Local solar hour of the largest rate per cell, where the mean of the hourly rates is high enough."""
    hourly = _stack(rain, views, [*CELL, "hour"]).withColumn("rate", _rate(min_views))
    peak = argmax_by(hourly.withColumn("rate_or", F.coalesce("rate", F.lit(-1.0))), "rate_or", "hour", tuple(CELL))
    mean = hourly.groupBy(*CELL).agg(F.avg("rate").alias("mean_rate"))
    return (
        peak.join(mean, CELL)
        .where(F.col("mean_rate") > min_rain)
        .select(*CELL, S.local_hour_of_cell("hour", S.cell_lon("lon_bin", deg)).alias("peak_lst"), "mean_rate")
    )


def zonal_mean(rain: DataFrame, views: DataFrame, by: tuple = (), breakdown: str = "size") -> DataFrame:
    """Rain of each class over all views of its latitude; zero where a viewed latitude has none."""
    wet = rain.groupBy(*by, "lat_bin", "class").agg(F.sum("rain_sum").alias("rain_sum"))
    seen = views.groupBy(*by, "lat_bin").agg(F.sum("n_views").alias("n_views"))
    return _with_classes(seen, rain, breakdown).join(wet, [*by, "lat_bin", "class"], "left").select(
        *by, "lat_bin", "class", F.try_divide(F.coalesce("rain_sum", F.lit(0.0)), "n_views").alias("rate")
    )


def class_rates(rain: DataFrame, views: DataFrame, breakdown: str = "size") -> DataFrame:
    """Rate, frequency and intensity of each class per viewed cell, months and hours pooled; zero without rain."""
    wet = rain.groupBy(*CELL, "class").agg(F.sum("rain_sum").alias("rain_sum"), F.sum("raining_count").alias("raining_count"))
    seen = views.groupBy(*CELL).agg(F.sum("n_views").alias("n_views"))
    both = _with_classes(seen, rain, breakdown).join(wet, [*CELL, "class"], "left").fillna(0, ["rain_sum", "raining_count"])
    return both.select(
        *CELL,
        "class",
        F.try_divide("rain_sum", "n_views").alias("rate"),
        F.try_divide("raining_count", "n_views").alias("freq"),
        F.try_divide("rain_sum", "raining_count").alias("intensity"),
    )


def class_fraction_by_lat(rain: DataFrame, by: tuple = ()) -> DataFrame:
    wet = rain.groupBy(*by, "lat_bin", "class").agg(F.sum("rain_sum").alias("rain_sum"))
    total = F.sum("rain_sum").over(Window.partitionBy(*by, "lat_bin"))
    return wet.withColumn("frac", F.try_divide(F.col("rain_sum"), total)).drop("rain_sum")


def mission_difference(
    rain: DataFrame, views: DataFrame, band=(-37.0, 37.0), deg: float = C.GRID_DEG, min_views: int = 5, a="GPM", b="TRMM"
) -> DataFrame:
    """Rates of the cells both missions see often enough, and their difference."""
    cells = _stack(clip_band(rain, band=band, deg=deg), clip_band(views, band=band, deg=deg), ["mission", *CELL])
    rated = cells.withColumn("rate", _rate(min_views)).where("rate IS NOT NULL")
    return pair_missions(rated, a, b, ["rate"]).withColumn("difference", F.col("rate_a") - F.col("rate_b"))


def hovmoller(rain: DataFrame, views: DataFrame, min_views: int = 5) -> DataFrame:
    """Latitude x month: unweighted mean over longitude of the cell rates."""
    cells = _stack(rain, views, ["month", *CELL]).withColumn("rate", _rate(min_views))
    return cells.where("rate IS NOT NULL").groupBy("month", "lat_bin").agg(F.avg("rate").alias("rate"))


def diurnal_contrast(
    rain: DataFrame, views: DataFrame, hours_a, hours_b, quantity: str = "rate"
) -> DataFrame:
    """Quantity over one set of hours minus the same over another, per cell."""
    sides = []
    for tag, hours in (("a", hours_a), ("b", hours_b)):
        mine = F.col("hour").isin([int(h) for h in hours])
        sides.append((tag, mine))
    both = rain.select(*CELL, "hour", "rain_sum", "raining_count").unionByName(
        views.select(*CELL, "hour", "n_views"), allowMissingColumns=True
    )
    sums = [
        F.sum(F.when(mine, F.coalesce(c, F.lit(0)))).alias(f"{c}_{tag}")
        for tag, mine in sides
        for c in ("rain_sum", "raining_count", "n_views")
    ]
    num, den = {"rate": ("rain_sum", "n_views"), "freq": ("raining_count", "n_views"), "intensity": ("rain_sum", "raining_count")}[quantity]
    g = both.groupBy(*CELL).agg(*sums)
    a, b = (F.try_divide(f"{num}_{t}", f"{den}_{t}") for t in "ab")
    return g.select(*CELL, a.alias("value_a"), b.alias("value_b"), (a - b).alias("contrast")).where("contrast IS NOT NULL")


def _boxes(rain: DataFrame, views: DataFrame, factors: tuple, band, deg: float) -> DataFrame:
    cells = _stack(rain, views, CELL)
    return pyramid(cells, factors, ["rain_sum", "raining_count", "n_views"], band, deg)


def resolution_curve(
    rain: DataFrame,
    views: DataFrame,
    factors: tuple = (1, 2, 5, 10, 20, 50),
    band=C.SHARED_LAT_CLIP,
    deg: float = C.GRID_DEG,
    min_views: int = 10,
    wet_rate: float = 0.005,
) -> DataFrame:
    """Per block size: mean rate, conditional rate over wet blocks, share of all blocks that are wet."""
    lo, hi = S.lat_clip_bins(band=band, deg=deg)
    blocks = F.lit(0)
    for f in factors:
        total = ((hi - lo + 1) // f) * (S.n_lon(deg) // f)
        blocks = F.when(F.col("factor") == f, F.lit(total)).otherwise(blocks)
    boxes = _boxes(rain, views, factors, band, deg).withColumn("rate", _rate(min_views))
    wet = F.col("rate") > wet_rate
    return (
        boxes.groupBy("factor")
        .agg(
            F.avg("rate").alias("mean_rate"),
            F.avg(F.when(wet, F.try_divide("rain_sum", "raining_count"))).alias("cond_rate"),
            F.count_if(wet).alias("n_wet"),
        )
        .select(
            "factor",
            (F.col("factor") * F.lit(deg)).alias("box_deg"),
            "mean_rate",
            "cond_rate",
            (F.col("n_wet") / blocks).alias("wet_frac"),
        )
    )


def rate_pdf(
    rain: DataFrame,
    views: DataFrame,
    factors: tuple = (1, 4, 20),
    edges: int = 60,
    lo_exp: float = -3.0,
    hi_exp: float = 1.0,
    band=C.SHARED_LAT_CLIP,
    deg: float = C.GRID_DEG,
    min_views: int = 10,
) -> DataFrame:
    """Density of the positive block rates over log-spaced bins, per block size."""
    step = (hi_exp - lo_exp) / (edges - 1)
    last = edges - 2
    boxes = _boxes(rain, views, factors, band, deg).withColumn("rate", _rate(min_views)).where("rate > 0")
    inside = boxes.where((F.col("rate") >= math.pow(10, lo_exp)) & (F.col("rate") <= math.pow(10, hi_exp)))
    b = F.greatest(F.least(F.floor((F.log10("rate") - lo_exp) / F.lit(step)), F.lit(last)), F.lit(0)).cast("int")
    g = inside.groupBy("factor", b.alias("b")).agg(F.count("*").alias("n"))
    width = F.pow(F.lit(10.0), lo_exp + (F.col("b") + 1) * step) - F.pow(F.lit(10.0), lo_exp + F.col("b") * step)
    total = F.sum("n").over(Window.partitionBy("factor"))
    return g.withColumn("density", F.col("n") / (total * width))


def member_zonal(totals: DataFrame, min_views: int = 50) -> DataFrame:
    """Zonal rate of each member (columns member, lat_bin, rain_sum, n_views)."""
    g = totals.groupBy("member", "lat_bin").agg(F.sum("rain_sum").alias("rain_sum"), F.sum("n_views").alias("n_views"))
    return g.where(F.col("n_views") >= min_views).select("member", "lat_bin", F.try_divide("rain_sum", "n_views").alias("rate"))


def regional_zoom(
    totals: DataFrame,
    member: str = "COMBINED",
    lon=(90.0, 150.0),
    lat=(-12.0, 12.0),
    deg: float = C.GRID_DEG,
    min_views: int = 10,
) -> DataFrame:
    """Unconditional rate, frequency (percent) and conditional rate of the cells in a window."""
    y, x = S.cell_lat("lat_bin", deg), S.cell_lon("lon_bin", deg)
    box = totals.where((F.col("member") == member) & y.between(*lat) & x.between(*lon))
    seen = F.col("n_views") >= min_views
    return box.select(
        *CELL,
        F.when(seen, F.try_divide("rain_sum", "n_views")).alias("uncond"),
        F.when(seen, 100.0 * F.try_divide("raining", "n_views")).alias("freq"),
        F.when(F.col("raining") >= 1, F.try_divide("rain_sum", "raining")).alias("cond"),
    )
