"""Reanalysis environment of each feature: wind shear, centroid values, box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.scalars import is_number, nearest_hour
from rainloom.schemas import ENV, conform
from rainloom.session import growing, materialize

CELL = ["hour", "iy", "ix"]
N_LON = round(360 / C.ENV_DEG)
MAX_IY = round(90 / C.ENV_DEG)
HALO = max(C.ENV_BOXES.values())
TILE = 32  # divides the number of longitudes
_STATS = ("min", "max", "mean", "std", *[f"p{p}" for p in C.ENV_PERCENTILES])


def _not_above(height: int):
    return lambda level: level["h"] <= float(height)


def _not_below(height: int):
    return lambda level: level["h"] >= float(height)


def _wind_at(component: str, height: int) -> Column:
    """Linear interpolation between the bracketing levels; outside the profile or under two levels gives null."""
    t = F.lit(float(height))
    lower, upper = F.col(f"_{component}_lo_{height}"), F.col(f"_{component}_hi_{height}")
    inside = (F.size(f"_{component}") >= 2) & lower.isNotNull() & upper.isNotNull()
    slope = (upper["w"] - lower["w"]) / F.when(upper["h"] > lower["h"], upper["h"] - lower["h"])
    return F.when(inside, F.coalesce(lower["w"] + (t - lower["h"]) * slope, lower["w"]))


def _profile(component: str) -> Column:
    lo, hi = C.LEVEL_RANGE_HPA
    usable = F.filter(
        "levels", lambda x: x["level"].between(lo, hi) & is_number(x["z"]) & is_number(x[component])
    )
    return F.transform(usable, lambda x: F.struct((x["z"] / C.GRAVITY).alias("h"), x[component].alias("w")))


def shear(reanalysis: DataFrame, heights=C.SHEAR_HEIGHTS_M) -> DataFrame:
    """Bulk shear of the 10 m wind to each height, once per analysis cell."""
    df = reanalysis.withColumns({"_u": _profile("u"), "_v": _profile("v")})
    # The brackets get columns of their own, so that each is searched once.
    brackets = {}
    for h in heights:
        for c in ("u", "v"):
            brackets[f"_{c}_lo_{h}"] = F.array_max(F.filter(f"_{c}", _not_above(h)))
            brackets[f"_{c}_hi_{h}"] = F.array_min(F.filter(f"_{c}", _not_below(h)))
    df = df.withColumns(brackets)
    cols = {}
    for h in heights:
        du = _wind_at("u", h) - F.col("u10")
        dv = _wind_at("v", h) - F.col("v10")
        cols[f"shear_{h}m"] = F.sqrt(du * du + dv * dv)
    keep = [*CELL, *[v for v in C.ENV_VARS if not v.startswith("shear_")]]
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def locate(features: DataFrame) -> DataFrame:
    """Feature meta columns with the nearest analysis hour and cell.

    Midpoints go to the even cell; longitude wraps at 360.
    """
    lat, lon = F.col("centroid_lat").cast("double"), F.pmod(F.col("centroid_lon").cast("double"), F.lit(360.0))
    return features.select(
        "feature_id",
        "mission",
        "orbit",
        "time",
        nearest_hour("time").alias("hour"),
        F.bround(lat / C.ENV_DEG).cast("int").alias("iy"),
        F.pmod(F.bround(lon / C.ENV_DEG).cast("int"), F.lit(N_LON)).alias("ix"),
    )


def centroid_values(features: DataFrame, cells: DataFrame) -> DataFrame:
    """The eight variables at the nearest cell and hour."""
    values = cells.select(*CELL, *[F.col(v).alias(f"{v}_centroid") for v in C.ENV_VARS])
    return locate(features).join(growing(values), CELL, "left").drop(*CELL)


def box_cells(centres: DataFrame, radius: int = max(C.ENV_BOXES.values())) -> DataFrame:
    """Analysis cells around each distinct centre: (hour, iy0, ix0) -> (hour, iy, ix, ring).

    ``ring`` is the larger of the two offsets, so every box is ``ring <= radius``.
    Longitude wraps; rows beyond a pole do not exist.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return (
        centres.select("hour", F.col("iy").alias("iy0"), F.col("ix").alias("ix0"))
        .distinct()
        .withColumn("dy", F.explode(steps))
        .where((F.col("iy0") + F.col("dy")).between(-MAX_IY, MAX_IY))
        .withColumn("dx", F.explode(steps))
        .select(
            "hour",
            "iy0",
            "ix0",
            (F.col("iy0") + F.col("dy")).alias("iy"),
            F.pmod(F.col("ix0") + F.col("dx"), F.lit(N_LON)).alias("ix"),
            F.greatest(F.abs("dy"), F.abs("dx")).alias("ring"),
        )
    )


def _tile_of(centres: DataFrame) -> DataFrame:
    """Tile of each distinct centre, and its place there (the halo comes first)."""
    ty, tx = F.floor(F.col("iy") / TILE), F.floor(F.col("ix") / TILE)
    return centres.select(*CELL).distinct().withColumns(
        {
            "ty": ty.cast("int"),
            "tx": tx.cast("int"),
            "cy": (F.col("iy") - ty * TILE + HALO).cast("int"),
            "cx": (F.col("ix") - tx * TILE + HALO).cast("int"),
        }
    )


def near_cells(features: DataFrame, reanalysis: DataFrame) -> DataFrame:
    """Cells of the tiles around any feature's centre, and no other hours or places."""
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    tiles = (
        _tile_of(locate(features))
        .select("hour", "ty", "tx")
        .distinct()
        .withColumn("dy", F.explode(steps))
        .withColumn("dx", F.explode(steps))
        .select(F.col("hour"), (F.col("ty") + F.col("dy")).alias("_ty"), F.pmod(F.col("tx") + F.col("dx"), F.lit(N_LON // TILE)).alias("_tx"))
        .distinct()
    )
    own = reanalysis.withColumns({"_ty": F.floor(F.col("iy") / TILE).cast("int"), "_tx": F.floor(F.col("ix") / TILE).cast("int")})
    return own.join(growing(tiles), ["hour", "_ty", "_tx"], "left_semi").drop("_ty", "_tx")


def _packed(cells: DataFrame, tiles: DataFrame, variables) -> DataFrame:
    """One row per tile that has a centre: its cells and those of its halo in one bounded array.

    A cell goes to its own tile and to those whose halo it lies in, fewer than three on average.
    """
    ends = F.array(F.lit(-HALO), F.lit(HALO))
    copies = (
        cells.where(F.abs("iy") <= MAX_IY)
        .withColumn("ty", F.explode(F.array_distinct(F.transform(ends, lambda d: F.floor((F.col("iy") + d) / TILE).cast("int")))))
        .withColumn("tx", F.explode(F.array_distinct(F.transform(ends, lambda d: F.pmod(F.floor((F.col("ix") + d) / TILE), F.lit(N_LON // TILE)).cast("int")))))
        .join(growing(tiles.select("hour", "ty", "tx").distinct()), ["hour", "ty", "tx"], "left_semi")
    )
    values = F.array(*[F.when(is_number(v), F.col(v).cast("double")) for v in variables]).alias("values")
    y = (F.col("iy") - F.col("ty") * TILE + HALO).cast("int").alias("y")
    x = F.pmod(F.col("ix") - F.col("tx") * TILE + HALO, F.lit(N_LON)).cast("int").alias("x")
    return copies.groupBy("hour", "ty", "tx").agg(F.collect_list(F.struct(y, x, values)).alias("cells"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _statistics(values: Column) -> Column:
    """Extremes, mean, deviation and percentiles of a sorted array."""
    n = F.size(values)
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))
    mean = F.when(n > 0, total(lambda x: x) / n)

    def percentile(p: int) -> Column:
        spot = (n - 1) * F.lit(p / 100.0)
        low, high = F.get(values, F.floor(spot).cast("int")), F.get(values, F.ceil(spot).cast("int"))
        return low + (high - low) * (spot - F.floor(spot))

    return _bound(
        mean,
        lambda m: F.struct(
            F.get(values, F.lit(0)).alias("min"),
            F.get(values, n - 1).alias("max"),
            m.alias("mean"),
            F.sqrt(total(lambda x: (x - m) * (x - m)) / F.when(n > 0, n)).alias("std"),
            *[percentile(p).alias(f"p{p}") for p in C.ENV_PERCENTILES],
        ),
    )


def box_stats(features: DataFrame, cells: DataFrame, variables=C.ENV_VARS) -> DataFrame:
    """Statistics of every variable over the three boxes around each feature.

    Cells travel to tiles with a halo and are packed there; each distinct centre joins its tile as
    one row and takes its boxes (441 cells at most) from the array. Longitude wraps; rows beyond
    a pole do not exist.
    """
    located = locate(features)
    centres = _tile_of(located)
    joined = centres.join(growing(_packed(cells, centres, variables)), ["hour", "ty", "tx"])

    def ring(s: Column) -> Column:
        return F.greatest(F.abs(s["y"] - F.col("cy")), F.abs(s["x"] - F.col("cx")))

    def all_boxes(box: Column) -> Column:
        def one(spec: Column) -> Column:
            mine = F.filter(box, lambda s: (ring(s) <= spec["radius"]) & F.get(s["values"], spec["variable"]).isNotNull())
            return _bound(F.array_sort(F.transform(mine, lambda s: F.get(s["values"], spec["variable"]))), _statistics)

        return F.transform(specs, one)

    # one expression for all variables and boxes, which keeps the plan small
    wanted = [(i, v, name, radius) for i, v in enumerate(variables) for name, radius in C.ENV_BOXES.items()]
    specs = F.array(*[F.struct(F.lit(i).alias("variable"), F.lit(radius).alias("radius")) for i, _, _, radius in wanted])
    box = F.filter("cells", lambda s: ring(s) <= HALO)
    stats = joined.select(*CELL, _bound(box, all_boxes).alias("s"))
    cols = [F.get("s", F.lit(k))[stat].alias(f"{stat}_{v}_{name}") for k, (_, v, name, _) in enumerate(wanted) for stat in _STATS]
    return located.join(growing(stats), CELL, "left").select("feature_id", "mission", "orbit", "time", *cols)


def env_for_features(features: DataFrame, reanalysis: DataFrame) -> DataFrame:
    """The 252-column environment table; features without analysis data keep null values.

    The analysis is read once, for the tiles around the features only, and its shear is computed and
    stored once for both joins.
    """
    cells = materialize(shear(near_cells(features, reanalysis)), "analysis")
    boxes = box_stats(features, cells).drop("mission", "orbit", "time")
    return conform(centroid_values(features, cells).join(growing(boxes), "feature_id"), ENV)


def left_env(features: DataFrame, env: DataFrame) -> DataFrame:
    """All features, environment columns null where there is none."""
    return features.join(growing(env.drop("mission", "orbit", "time")), "feature_id", "left")


def build_analysis_table(features: DataFrame, env: DataFrame, lat_max: float = 40.0) -> DataFrame:
    """Features joined with their environment equatorward of ``lat_max``, plus derived columns."""
    joined = features.where(F.abs("centroid_lat") < lat_max).join(growing(env.drop("mission", "orbit", "time")), "feature_id")
    return analysis_columns(joined)


def analysis_columns(df: DataFrame) -> DataFrame:
    from rainloom.functions.scalars import population

    return df.withColumns(
        {
            "surf": population(),
            "abs_lat": F.abs("centroid_lat"),
            **{f"ht{t}_km": F.col(f"max_ht_{t}dbz") / 1000.0 for t in C.ECHO_THRESHOLDS},
        }
    )
