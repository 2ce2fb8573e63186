"""Footprint area from neighbour spacing.

Neighbours along and across track are found inside *scan tiles*: an orbit is cut
into blocks of consecutive scans, each carrying one overlapping scan from either
side. A tile is the unit of partitioning, so neither a long orbit nor one orbit
holding most of the data ends up in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.scalars import haversine_km, int_div

TILE_SCANS = 64
TILE = ["mission", "orbit", "tile"]


def scan_tiles(df: DataFrame, scans: int = TILE_SCANS) -> DataFrame:
    """Add ``tile`` and ``is_core``; scans on a tile border are repeated in the next tile."""
    home = int_div("scan", scans)
    offset = F.pmod(F.col("scan"), F.lit(scans))
    tiles = F.array(
        home,
        F.when(offset == 0, home - 1),
        F.when(offset == scans - 1, home + 1),
    )
    return (
        df.withColumn("tile", F.explode(F.array_compact(tiles)))
        .withColumn("is_core", F.col("tile") == home)
        .repartition(*TILE)
    )


def footprint_area(swath: DataFrame, out: str = "pixel_area") -> DataFrame:
    """(pixel key, footprint in km2): product of the two mean neighbour distances.

    Only positions are read and shuffled; the result stays a narrow table, to be joined to
    the pixels that need it rather than to the whole swath with its vertical arrays.

    A side without a pixel is a swath edge (one-sided distance); a neighbour that is
    there without a position makes the area null.
    """
    keys = ["mission", "orbit", "scan", "ray"]
    narrow = swath.select(*keys, "lat", "lon")

    def spacing(along: str, across: str) -> F.Column:
        w = Window.partitionBy(*TILE, across).orderBy(along)
        before = F.lag(along, 1).over(w) == F.col(along) - 1
        after = F.lead(along, 1).over(w) == F.col(along) + 1
        d_before = haversine_km(F.lag("lat", 1).over(w), F.lag("lon", 1).over(w), "lat", "lon")
        d_after = haversine_km("lat", "lon", F.lead("lat", 1).over(w), F.lead("lon", 1).over(w))
        return (
            F.when(before & after, 0.5 * (d_before + d_after))
            .when(F.coalesce(before, F.lit(False)), d_before)
            .when(F.coalesce(after, F.lit(False)), d_after)
        )

    return (
        scan_tiles(narrow)
        .withColumn("dy", spacing("scan", "ray"))
        .withColumn("dx", spacing("ray", "scan"))
        .where("is_core")
        .select(*keys, (F.col("dx") * F.col("dy")).cast("float").alias(out))
    )
