"""Analyses of the feature catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.functions.ranking import cumulative_share, exact_percentiles, normalise_to_mean, share_of_total


def _pick(features: DataFrame, mission: str | None) -> DataFrame:
    return features if mission is None else features.where(F.col("mission") == mission)


def _percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * F.try_divide(part, whole)


def _sum_rain() -> Column:
    return F.sum("volrain_total")


def ocean_or_land(other: str) -> Column:
    return F.when(F.col("frac_ocean") >= 0.5, F.lit("ocean")).otherwise(F.lit(other))


def class_contribution(features: DataFrame, mission: str | None = None) -> DataFrame:
    """Share of features and of rain by class, with mean size, temperature and convective rain."""
    g = (
        _pick(features, mission)
        .groupBy("feature_class")
        .agg(
            F.count("*").alias("n_feat"),
            _sum_rain().alias("rain"),
            F.avg("area_km2").alias("mean_area_km2"),
            F.avg("min_pct_85_89").alias("mean_min_pct"),
            _percent(F.sum("volrain_conv"), _sum_rain()).alias("conv_rain_pct"),
        )
    )
    return share_of_total(share_of_total(g, "n_feat", name="pct_feat"), "rain", name="pct_rain")


def rain_by_size(features: DataFrame, mission: str | None = None, dex: float = 0.2) -> DataFrame:
    """Rain share per log10 area bin and surface, plain and cumulative."""
    g = (
        _pick(features, mission)
        .where("area_km2 > 0")
        .groupBy(ocean_or_land("land/coast").alias("surf"), F.floor(F.log10("area_km2") / F.lit(dex)).cast("int").alias("b"))
        .agg(_sum_rain().alias("rain"))
    )
    return cumulative_share(share_of_total(g, "rain", ("surf",)), "b", "rain", ("surf",))


def rain_by_intensity(features: DataFrame, mission: str | None = None) -> DataFrame:
    """Rain share by 1 km bins of the 40 dBZ top and by 10 K bins of the minimum temperature."""
    f = _pick(features, mission)
    axes = F.array(
        F.struct(F.lit("ht40").alias("axis"), F.floor(F.col("max_ht_40dbz") / 1000.0).cast("int").alias("b")),
        F.struct(F.lit("pct85").alias("axis"), (F.floor(F.col("min_pct_85_89") / 10.0) * 10).cast("int").alias("b")),
    )
    g = (
        f.select(F.explode(axes).alias("x"), "volrain_total")
        .where("x.b IS NOT NULL")
        .groupBy("x.axis", "x.b")
        .agg(_sum_rain().alias("rain"))
    )
    return share_of_total(g, "rain", ("axis",))


def conv_strat_share(features: DataFrame, mission: str | None = None, by: str = "surface") -> DataFrame:
    """Convective and stratiform percent of rain by surface or by 2.5 degree latitude."""
    f = _pick(features, mission)
    shares = [
        _percent(F.sum("volrain_conv"), _sum_rain()).alias("conv_pct"),
        _percent(F.sum("volrain_strat"), _sum_rain()).alias("strat_pct"),
    ]
    if by == "surface":
        return f.groupBy(S.population().alias("surf")).agg(*shares)
    lat = F.floor(F.col("centroid_lat") / 2.5) * 2.5 + 1.25
    return f.groupBy(lat.alias("lat")).agg(*shares)


def _on_map(features: DataFrame, deg: float) -> DataFrame:
    n_lat, n_lon = S.n_lat(deg), S.n_lon(deg)
    inside = (
        (F.col("centroid_lon") >= -180)
        & (F.col("centroid_lon") < 180)
        & (F.col("centroid_lat") >= -90)
        & (F.col("centroid_lat") < 90)
    )
    # rounding at the upper edge would give one bin too many
    ix = F.least(F.floor((F.col("centroid_lon") + 180.0) / F.lit(deg)), F.lit(n_lon - 1)).cast("int")
    iy = F.least(F.floor((F.col("centroid_lat") + 90.0) / F.lit(deg)), F.lit(n_lat - 1)).cast("int")
    return features.where(inside).withColumns({"ix": ix, "iy": iy})


def rain_map(features: DataFrame, mission: str | None = None, deg: float = 2.5) -> DataFrame:
    """Rain and MCS percent of rain per box."""
    return (
        _on_map(_pick(features, mission), deg)
        .groupBy("ix", "iy")
        .agg(
            _sum_rain().alias("rain_all"),
            F.coalesce(F.sum(F.when(F.col("feature_class") == "MCS", F.col("volrain_total"))), F.lit(0.0)).alias("rain_mcs"),
        )
        .withColumn("mcs_pct", _percent(F.col("rain_mcs"), F.col("rain_all")))
    )


def diurnal_features(features: DataFrame, mission: str | None = None, by: str = "surface") -> DataFrame:
    """Rain by local solar hour relative to the daily mean, by surface or MCS; 24 rows per group."""
    f = _pick(features, mission).where("time IS NOT NULL")
    group = ocean_or_land("land") if by == "surface" else F.when(F.col("is_mcs"), F.lit("MCS")).otherwise(F.lit("non-MCS"))
    g = (
        f.groupBy(group.alias("grp"), S.local_solar_hour("time", "centroid_lon").alias("lst"))
        .agg(_sum_rain().alias("rain"))
    )
    hours = g.select("grp").distinct().withColumn("lst", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = hours.join(g, ["grp", "lst"], "left").fillna(0.0, ["rain"])
    return normalise_to_mean(full, "rain", ("grp",))


def size_rate_histogram(
    features: DataFrame, mission: str | None = None, dex: float = 0.2, rate_width: float = 0.5, rate_max: float = 25.0
) -> DataFrame:
    """Count and rain over log area x conditional rate (capped into the last bin)."""
    rate = F.least(F.col("volrain_total") / F.col("area_km2"), F.lit(rate_max))
    last = round(rate_max / rate_width) - 1
    return (
        _pick(features, mission)
        .where("area_km2 > 0 AND volrain_total > 0")
        .groupBy(
            F.floor(F.log10("area_km2") / F.lit(dex)).cast("int").alias("area_bin"),
            F.least(F.floor(rate / F.lit(rate_width)), F.lit(last)).cast("int").alias("rate_bin"),
        )
        .agg(F.count("*").alias("n"), _sum_rain().alias("rain"))
    )


def in_regions(df: DataFrame, regions: dict = C.REGIONS, lat="centroid_lat", lon="centroid_lon") -> DataFrame:
    """One row per region box a row falls in (boxes overlap, ends included).

    Nine fixed boxes: tested in place, no join.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col(lat).between(a, b) & F.col(lon).between(c, d), F.lit(name))
                for name, (a, b, c, d) in regions.items()
            ]
        )
    )
    return df.withColumn("region", F.explode(hits))


def regional_morphology(features: DataFrame, mission: str | None = None, regions: dict = C.REGIONS) -> DataFrame:
    return (
        in_regions(_pick(features, mission), regions)
        .groupBy("region")
        .agg(
            _percent(F.sum(F.when(F.col("feature_class") == "MCS", F.col("volrain_total"))), _sum_rain()).alias("mcs_rain_pct"),
            _percent(F.sum("volrain_conv"), _sum_rain()).alias("conv_pct"),
            (F.avg("max_ht_40dbz") / 1000.0).alias("mean_ht_km"),
            F.avg("min_pct_85_89").alias("mean_min_pct"),
            F.count("*").alias("n"),
        )
    )


def monthly_inventory(features: DataFrame, mission: str | None = None, low_share: float = 0.2) -> DataFrame:
    """Features per mission, year and month; ``is_low`` under a fifth of the mission's median month."""
    inv = (
        _pick(features, mission)
        .groupBy("mission", F.year("time").alias("year"), F.month("time").alias("month"))
        .agg(F.count("*").alias("n_pfs"))
    )
    mid = exact_percentiles(inv, ("mission",), "n_pfs", {"median_n": 0.5}, bounded=True).drop("n")
    return inv.join(F.broadcast(mid), "mission").withColumn("is_low", F.col("n_pfs") < low_share * F.col("median_n"))


def count_map(features: DataFrame, mission: str | None = None, deg: float = 0.25) -> DataFrame:
    return _on_map(_pick(features, mission), deg).groupBy("ix", "iy").agg(F.count("*").alias("n"))


def longitude_profile(
    features: DataFrame, mission: str | None = None, lo: float = -105.0, hi: float = -95.0
) -> DataFrame:
    """Counts per 1 degree of longitude and surface population."""
    return (
        _pick(features, mission)
        .where((F.col("centroid_lon") >= lo) & (F.col("centroid_lon") < hi))
        .groupBy(F.floor("centroid_lon").cast("int").alias("lon_bin"), S.population().alias("pop"))
        .agg(F.count("*").alias("n"))
    )


def population_table(features: DataFrame) -> DataFrame:
    """Counts by population per mission, total and row percents."""
    kinds = ["land", "ocean", "coast"]
    wide = (
        features.withColumn("population", S.population())
        .groupBy("mission")
        .pivot("population", kinds)
        .agg(F.count(F.lit(1)))
        .fillna(0, kinds)
        .withColumn("total", F.col("land") + F.col("ocean") + F.col("coast"))
    )
    return wide.withColumns({f"{k}_pct": _percent(F.col(k), F.col("total")) for k in kinds})


def pdf_by_population(
    features: DataFrame,
    value: Column | str,
    lo: float,
    hi: float,
    bins: int = 60,
    positive_only: bool = False,
    mission: str | None = None,
    min_total: int = 10,
) -> DataFrame:
    """Density histogram of a value by population; groups of at most ``min_total`` are left out."""
    x = F.col(value) if isinstance(value, str) else value
    width = (hi - lo) / bins
    f = _pick(features, mission).where(S.is_number(x) & (x >= lo) & (x < hi))
    if positive_only:
        f = f.where(x > 0)
    b = F.least(F.greatest(F.floor((x - lo) / F.lit(width)).cast("int"), F.lit(0)), F.lit(bins - 1))
    g = f.groupBy(S.population().alias("pop"), b.alias("b")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("pop"))
    return (
        g.withColumn("total", total)
        .where(F.col("total") > min_total)
        .withColumn("density", F.col("n") / (F.col("total") * F.lit(width)))
    )


def mission_totals(features: DataFrame) -> DataFrame:
    return features.groupBy("mission").agg(
        F.count("*").alias("n"),
        _sum_rain().alias("rain"),
        F.min("centroid_lat").alias("lat_lo"),
        F.max("centroid_lat").alias("lat_hi"),
    )
