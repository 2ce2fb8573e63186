"""Nearest-neighbour co-location of imager temperatures on the radar swath."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.scalars import decode_fill, haversine_km, is_number, pct
from rainloom.operators.geometry import footprint_area
from rainloom.session import discard, growing, materialize

PIXEL = ["mission", "orbit", "scan", "ray"]
CHANNEL = ["mission", "orbit", "channel"]
KM_PER_DEG = math.pi * C.EARTH_RADIUS_KM / 180.0
TILE = 4  # sides of a tile of the search, in radii: fewer copies of targets, more pairs


def imager_pct(imager: DataFrame) -> DataFrame:
    """Add ``pct`` from the two polarisations, with each channel's coefficients."""
    v, h = decode_fill("tc_v"), decode_fill("tc_h")
    value = F.when(F.col("channel") == "85_89", pct(v, h, *C.PCT_85_89)).when(
        F.col("channel") == "37", pct(v, h, *C.PCT_37)
    )
    return imager.withColumn("pct", value)


def check_channel_order(imager: DataFrame) -> DataFrame:
    """Orbits whose mean vertical temperature does not exceed the mean horizontal one."""
    return (
        imager.groupBy(*CHANNEL)
        .agg(F.avg(decode_fill("tc_v")).alias("mean_v"), F.avg(decode_fill("tc_h")).alias("mean_h"))
        .where(~(F.col("mean_v") > F.col("mean_h")))
    )


def parallax_direction(imager: DataFrame) -> DataFrame:
    """Per orbit and channel: -1 if the later scan lies toward the sub-satellite point, else +1.

    Compares the mean distance from the sub-point of each interior scan to the mid-ray pixel
    of the scan before and after it. Every scan sends its mid pixel to its two neighbours, so
    one aggregation per scan replaces a window over the whole orbit.
    """
    mid = imager.groupBy(*CHANNEL).agg(F.floor((F.max("ray") + 1) / 2).cast("int").alias("mid"))
    centre = imager.join(F.broadcast(mid), CHANNEL).where("ray = mid")  # a row per orbit and channel
    parts = F.array(
        F.struct(F.lit("sub").alias("kind"), F.col("scan").alias("at"), F.col("sc_lat").alias("y"), F.col("sc_lon").alias("x")),
        F.struct(F.lit("prev").alias("kind"), (F.col("scan") + 1).alias("at"), F.col("lat").alias("y"), F.col("lon").alias("x")),
        F.struct(F.lit("next").alias("kind"), (F.col("scan") - 1).alias("at"), F.col("lat").alias("y"), F.col("lon").alias("x")),
    )
    spread = centre.select(*CHANNEL, F.explode(parts).alias("p")).select(*CHANNEL, "p.*")

    def pick(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("y", "x"))).alias(kind)

    interior = (
        spread.groupBy(*CHANNEL, "at")
        .agg(pick("sub"), pick("prev"), pick("next"))
        .where("sub IS NOT NULL AND prev IS NOT NULL AND next IS NOT NULL")
    )
    toward = interior.groupBy(*CHANNEL).agg(
        F.avg(haversine_km("sub.y", "sub.x", "prev.y", "prev.x")).alias("d_prev"),
        F.avg(haversine_km("sub.y", "sub.x", "next.y", "next.x")).alias("d_next"),
    )
    shift = F.when(F.col("d_prev").isNull() | F.col("d_next").isNull() | (F.col("d_next") < F.col("d_prev")), F.lit(-1))
    return mid.join(toward, CHANNEL, "left").select(*CHANNEL, shift.otherwise(F.lit(1)).alias("shift"))


def parallax_shift(imager: DataFrame) -> DataFrame:
    """Imager pixels with the coordinates of the scan one step toward the sub-point.

    The last row in that direction keeps its own coordinates.
    """
    moved = imager.join(F.broadcast(parallax_direction(imager)), CHANNEL)
    donor = moved.select(
        *CHANNEL,
        (F.col("scan") + F.col("shift")).alias("scan"),
        "ray",
        F.struct("lat", "lon").alias("there"),
    )
    joined = moved.join(growing(donor), [*CHANNEL, "scan", "ray"], "left")
    place = F.coalesce("there", F.struct("lat", "lon"))
    cols = [c for c in imager.columns if c not in ("lat", "lon")]
    return joined.select(*cols, place["lat"].alias("lat"), place["lon"].alias("lon"))


def _lat_band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(step)).cast("int")


def _lon_buckets(band: Column, step: float) -> Column:
    """How many longitude buckets a latitude band has: none narrower than ``step`` of arc."""
    # the edge of the band that lies farther from the equator
    far = F.greatest(F.abs(band * step - 90.0), F.abs((band + 1) * step - 90.0))
    shrink = F.cos(F.radians(F.least(far, F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0 / step) * shrink).cast("int"), F.lit(1))


def _lon_bucket(lon: Column, count: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * count).cast("int"), count - 1)


def _lon_reach(lat: Column, step: float) -> Column:
    """How far in longitude a circle of radius ``step`` around a place extends; all round if it holds a pole."""
    share = F.lit(math.sin(math.radians(step))) / F.cos(F.radians(lat))
    return F.when((F.abs(lat) + step < 90.0) & (share < 1.0), F.degrees(F.asin(share))).otherwise(F.lit(180.0))


def _buckets_within(lon: Column, reach: Column, count: Column) -> Column:
    """The longitude buckets of a band that [lon - reach, lon + reach] touches, each once."""
    x = F.pmod(lon + 180.0, F.lit(360.0))
    low = F.floor((x - reach) / 360.0 * count).cast("int")
    high = F.floor((x + reach) / 360.0 * count).cast("int")
    return F.transform(F.sequence(low, F.least(high, low + count - 1)), lambda b: F.pmod(b, count))


def _unit_vector(side: str) -> dict[str, Column]:
    lat, lon = F.radians(f"{side}_lat"), F.radians(f"{side}_lon")
    return {
        f"{side}_x": F.cos(lat) * F.cos(lon),
        f"{side}_y": F.cos(lat) * F.sin(lon),
        f"{side}_z": F.sin(lat),
    }


def nearest_within(
    targets: DataFrame,
    sources: DataFrame,
    value: str,
    radius_m: float = C.COLOCATE_RADIUS_M,
    group: tuple[str, ...] = ("mission", "orbit"),
    target_key: tuple[str, ...] = ("scan", "ray"),
    first_m: float | None = None,
) -> DataFrame:
    """Per target: value, place and distance of the nearest source within ``radius_m``.

    A smaller radius, ``first_m`` (a third unless given; 0 for none), is searched first, and only
    targets without a source there go on to the whole radius; what is found within the smaller one
    is the nearest anyway. Pairs grow with the square of the radius.

    Both sides fall into tiles, ``TILE`` radii high and at least as wide, and meet there in an equi join.
    A source is in one tile; a target goes to every tile that its circle reaches, two on average. Sources at
    one and the same position are merged in their tile (first in scan, ray order wins), so copies of a
    position cannot multiply. Ties in distance go to the first scan, ray.
    """
    first_m = radius_m / 3 if first_m is None else first_m
    if 0 < first_m < radius_m:
        found = materialize(nearest_within(targets, sources, value, first_m, group, target_key, 0), "nearest")
        same = reduce(lambda a, b: a & b, [targets[k].eqNullSafe(found[k]) for k in (*group, *target_key)])
        rest = targets.join(growing(found), same, "left_anti")
        return found.unionByName(nearest_within(rest, sources, value, radius_m, group, target_key, 0))
    step = radius_m / 1000.0 / KM_PER_DEG * 1.02
    keys = list(group)
    tile = [*keys, "band", "bucket"]
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")

    # Positions travel as two numbers; their unit vectors are taken where they meet.
    spots = (
        sources.where(is_number("lat") & is_number("lon"))
        .select(*keys, lat.alias("s_lat"), lon.alias("s_lon"), "scan", "ray", F.col(value).alias("value"))
        .withColumn("band", _lat_band(F.col("s_lat"), TILE * step))
        .withColumn("bucket", _lon_bucket(F.col("s_lon"), _lon_buckets(F.col("band"), TILE * step)))
        .repartition(*tile)
        .groupBy(*tile, "s_lat", "s_lon")
        .agg(F.min(F.struct("scan", "ray", "value")).alias("src"))
        .withColumns(_unit_vector("s"))
    )
    seek = (
        targets.where(is_number("lat") & is_number("lon"))
        .select(*keys, *target_key, lat.alias("t_lat"), lon.alias("t_lon"))
        .withColumn("reach", _lon_reach(F.col("t_lat"), step))
        .withColumn("band", F.explode(F.sequence(_lat_band(F.col("t_lat") - step, TILE * step), _lat_band(F.col("t_lat") + step, TILE * step))))
        .withColumn("bucket", F.explode(_buckets_within(F.col("t_lon"), F.col("reach"), _lon_buckets(F.col("band"), TILE * step))))
        .drop("reach")
        .repartition(*tile)
        .withColumns(_unit_vector("t"))
    )
    # Squared chord on the unit sphere: trigonometry once per row, not once per pair.
    chord2 = sum((F.col(f"t_{a}") - F.col(f"s_{a}")) * (F.col(f"t_{a}") - F.col(f"s_{a}")) for a in "xyz")
    reach = 2.0 * math.sin(radius_m / 2000.0 / C.EARTH_RADIUS_KM)
    near = (
        seek.join(growing(spots), tile)
        .select(*keys, *target_key, chord2.alias("chord2"), "src")
        .where(F.col("chord2") <= reach * reach)
        .groupBy(*keys, *target_key)
        .agg(F.min(F.struct("chord2", "src.scan", "src.ray", "src.value")).alias("best"))
    )
    return near.select(
        *keys,
        *target_key,
        F.col("best.value").alias(value),
        (F.lit(2.0 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt("best.chord2") / 2.0)).alias("distance_km"),
        F.col("best.scan").alias("source_scan"),
        F.col("best.ray").alias("source_ray"),
    )


def parallax_gate(storm_top="storm_top", pia="pia") -> Column:
    """Deep, attenuating columns take the shifted temperature."""
    deep = is_number(storm_top) & (F.col(storm_top) > C.PARALLAX_STORMTOP_M)
    return deep & is_number(pia) & (F.col(pia) > C.PARALLAX_PIA_DB)


def colocate_pct(swath: DataFrame, imager: DataFrame, channels: tuple = ("85_89", "37")) -> DataFrame:
    """(pixel key, one ``pct_<channel>`` column each): shifted where gated, unshifted elsewhere.

    Each pixel is matched only against the geolocation its gate selects, and one channel is stored after the
    other, so that one channel's shuffle files are on disk at a time. The result is narrow; a pixel without any
    match has no row.
    """
    cols = ["mission", "orbit", "channel", "scan", "ray", "lat", "lon", "pct"]
    wanted = imager.where(F.col("channel").isin(*channels))
    geoloc = (
        wanted.select(*cols, F.lit(False).alias("shifted"))
        .unionByName(parallax_shift(wanted).select(*cols, F.lit(True).alias("shifted")))
    )
    geoloc = materialize(geoloc, "places")  # read by both radii
    targets = swath.select(*PIXEL, "lat", "lon", parallax_gate().alias("shifted"))
    near = []
    for c in channels:
        found = nearest_within(targets, geoloc.where(F.col("channel") == c), "pct", group=("mission", "orbit", "shifted"))
        near.append(materialize(found.select(*PIXEL, F.lit(c).alias("channel"), "pct"), f"near-{c}"))
    discard(geoloc)
    return reduce(DataFrame.unionByName, near).groupBy(*PIXEL).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("pct"))).cast("float").alias(f"pct_{c}") for c in channels]
    )


def pixel_context(swath: DataFrame, imager: DataFrame | None = None) -> DataFrame:
    """Narrow per-pixel side table: footprint area and co-located temperatures.

    Without an imager the temperatures are null.
    """
    area = footprint_area(swath)
    if imager is None:
        return area.withColumns({c: F.lit(None).cast("float") for c in ("pct_85_89", "pct_37")})
    return area.join(growing(colocate_pct(swath, imager)), PIXEL, "left")
