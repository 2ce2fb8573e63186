"""Storm response to environment: statistics over the analysis table.

The analysis table has one row per feature with its environment columns, ``surf``,
``abs_lat`` and the tops in km (see ``environment.analysis_columns``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.ranking import bin_floor, exact_percentiles, quantile_group, row_numbers
from rainloom.functions.scalars import convective, is_extreme_abs
from rainloom.plans.catalogue import in_regions

QUANTILE_STATS = {"median": 0.5, "p90": 0.9, "p99": 0.99}


def _pick(fe: DataFrame, mission, surf, conv_only: bool) -> DataFrame:
    for name, value in (("mission", mission), ("surf", surf)):
        if value is not None:
            fe = fe.where(F.col(name) == value)
    return fe.where(convective()) if conv_only else fe


def _statistic(df: DataFrame, by: tuple, response: str, stat: str) -> DataFrame:
    """(by, val, n) of one statistic of the non-null response."""
    if stat in QUANTILE_STATS:
        return exact_percentiles(df, by, response, {"val": QUANTILE_STATS[stat]})
    if stat != "mean":
        raise ValueError(f"unknown statistic {stat!r}")
    return df.groupBy(*by).agg(F.avg(F.col(response).cast("double")).alias("val"), F.count("*").alias("n"))


def _cape_shear_bins(fe: DataFrame, cape: str, shear: str) -> DataFrame:
    inside = (F.col(cape) < C.CAPE_MAX) & (F.col(shear) < C.SHEAR_MAX)
    return fe.where(inside).withColumns(
        {"cape_bin": bin_floor(cape, C.CAPE_WIDTH), "shear_bin": bin_floor(shear, C.SHEAR_WIDTH)}
    )


def composite_2d(
    fe: DataFrame,
    response: str,
    stat: str = "median",
    min_n: int = C.MIN_BIN_N,
    mission=None,
    surf=None,
    conv_only: bool = True,
    where: Column | None = None,
    cape: str = C.CAPE_COL,
    shear: str = C.SHEAR_COL,
) -> DataFrame:
    """Statistic of a response over CAPE x shear bins; thin bins keep their count, value null."""
    df = _pick(fe, mission, surf, conv_only)
    if where is not None:
        df = df.where(where)
    binned = _cape_shear_bins(df.where(F.col(response).isNotNull()), cape, shear)
    out = _statistic(binned, ("cape_bin", "shear_bin"), response, stat)
    return out.select(
        "cape_bin", "shear_bin", F.when(F.col("n") >= min_n, F.col("val")).alias("val"), F.col("n").cast("long").alias("n")
    )


def fixed_cape_lines(
    fe: DataFrame,
    response: str,
    stat: str = "median",
    min_n: int = C.MIN_BIN_N,
    mission=None,
    surf=None,
    conv_only: bool = True,
    cape: str = C.CAPE_COL,
    shear: str = C.SHEAR_COL,
    key: str = "feature_id",
) -> DataFrame:
    """Response against shear, one line per CAPE quartile."""
    df = _pick(fe, mission, surf, conv_only).where(
        F.col(cape).isNotNull() & F.col(response).isNotNull() & (F.col(shear) < C.SHEAR_MAX)
    )
    quartered = quantile_group(df.select(key, cape, shear, response), cape, 4, key, name="cape_quartile")
    binned = quartered.withColumn("shear_bin", bin_floor(shear, C.SHEAR_WIDTH))
    out = _statistic(binned, ("cape_quartile", "shear_bin"), response, stat)
    return out.where(F.col("n") >= min_n).select("cape_quartile", "shear_bin", "val", F.col("n").cast("long").alias("n"))


def quartile_ranges(fe: DataFrame, mission=None, surf=None, cape: str = C.CAPE_COL, key: str = "feature_id") -> DataFrame:
    """CAPE range of each quartile."""
    df = _pick(fe, mission, surf, False).select(key, cape)
    q = quantile_group(df, cape, 4, key, name="cape_quartile")
    return q.groupBy("cape_quartile").agg(F.min(cape).alias("lo"), F.max(cape).alias("hi"), F.count("*").alias("n"))


def joint_density(fe: DataFrame, mission=None, surf=None, cape: str = C.CAPE_COL, shear: str = C.SHEAR_COL) -> DataFrame:
    df = _cape_shear_bins(_pick(fe, mission, surf, False).where("area_km2 IS NOT NULL"), cape, shear)
    return df.groupBy("cape_bin", "shear_bin").agg(F.count("*").alias("n"))


def cape_shear_corr(fe: DataFrame, cape: str = C.CAPE_COL, shear: str = C.SHEAR_COL) -> DataFrame:
    """Correlation of CAPE and shear, and both medians, by mission and surface."""
    by = ("mission", "surf")
    corr = fe.groupBy(*by).agg(F.corr(cape, shear).alias("cape_shear_corr"))
    for col, name in ((cape, "med_cape"), (shear, "med_shear")):
        corr = corr.join(exact_percentiles(fe, by, col, {name: 0.5}).drop("n"), list(by), "left")
    return corr


def population_counts(fe: DataFrame, cape: str = C.CAPE_COL, shear: str = C.SHEAR_COL) -> DataFrame:
    return fe.groupBy("mission", "surf").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ht40_km") > 0).alias("deep_40dbz"),
        F.avg(shear).alias("mean_shear"),
        F.avg(cape).alias("mean_cape"),
    )


def mcs_share_2d(
    fe: DataFrame, min_n: int = C.MIN_BIN_N, mission=None, surf=None, cape: str = C.CAPE_COL, shear: str = C.SHEAR_COL
) -> DataFrame:
    """MCS probability and MCS percent of rain per CAPE x shear bin."""
    df = _cape_shear_bins(_pick(fe, mission, surf, False), cape, shear)
    mcs_rain = F.sum(F.when(F.col("feature_class") == "MCS", F.col("volrain_total")))
    return (
        df.groupBy("cape_bin", "shear_bin")
        .agg(
            F.avg(F.col("is_mcs").cast("double")).alias("p_mcs"),
            (F.lit(100.0) * F.try_divide(mcs_rain, F.sum("volrain_total"))).alias("mcs_rain_pct"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") >= min_n)
    )


def stratiform_response(fe: DataFrame, stat: str = "median", min_n: int = C.MIN_BIN_N, mission=None, surf=None) -> DataFrame:
    """Stratiform area over CAPE x shear within MCSs."""
    return composite_2d(
        fe, "strat_area_km2", stat, min_n, mission, surf, conv_only=False, where=F.col("feature_class") == "MCS"
    )


def regional_slope(
    fe: DataFrame, min_n: int = C.MIN_BIN_N, min_bins: int = 3, regions: dict = C.REGIONS_ENV,
    cape: str = C.CAPE_COL, shear: str = C.SHEAR_COL,
) -> DataFrame:
    """Per region: slope of the binned median 40 dBZ top on shear at mid CAPE, and MCS share at both ends."""
    df = fe.where(convective() & (F.col(shear) < C.SHEAR_MAX) & F.col(cape).between(500, 3000))
    binned = in_regions(df, regions).withColumn("shear_bin", bin_floor(shear, C.SHEAR_WIDTH))
    by = ("region", "shear_bin")
    base = binned.groupBy(*by).agg(F.avg(F.col("is_mcs").cast("double")).alias("p_mcs"), F.count("*").alias("n"))
    mid = exact_percentiles(binned, by, "ht40_km", {"ht": 0.5}).drop("n")
    points = base.where(F.col("n") >= min_n).join(mid, list(by), "left").withColumn("sb", F.col("shear_bin") * C.SHEAR_WIDTH)
    # at most fifteen bins per region from here on
    return (
        points.groupBy("region")
        .agg(
            F.round(F.regr_slope("ht", "sb"), 3).alias("slope"),
            F.sum("n").alias("n"),
            F.round(F.min_by("p_mcs", "sb"), 3).alias("p_mcs_lo"),
            F.round(F.max_by("p_mcs", "sb"), 3).alias("p_mcs_hi"),
            F.count("*").alias("n_bins"),
        )
        .where(F.col("n_bins") >= min_bins)
        .drop("n_bins")
    )


def sample_rows(
    fe: DataFrame, cols: list[str], n: int, seed: int = 0, key: str = "feature_id", mission: str | None = None, conv_only: bool = False, where: Column | None = None
) -> DataFrame:
    """A fixed-size random sample of the rows that pass the filters; the same rows for the same seed.

    The rows with the n smallest hashes of the key. A bound on the hash, which leaves somewhat more than
    n rows, is applied before the sort, and the sort is spread over ranges of the hash, so neither the
    input nor a large sample goes through one task.
    """
    rows = fe
    if mission is not None:
        rows = rows.where(F.col("mission") == mission.upper())
    if conv_only:
        rows = rows.where(convective())
    if where is not None:
        rows = rows.where(where)
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    share = (n + 10 * math.sqrt(n) + 10) / max(1, rows.count())
    if share < 1:
        near = hashed.where(F.col("_hash") < f"{int(share * (1 << 32)):08x}")
        if near.count() >= n:
            hashed = near
    return row_numbers(hashed, ["_hash", key], name="_rank").where(F.col("_rank") <= n).select(*cols)


def label_extremes(fe: DataFrame, prob: float = 0.99) -> DataFrame:
    """Absolute cuts and the per-surface percentile of the 40 dBZ top (no top counts as zero)."""
    df = fe.withColumn("ht40_km", F.coalesce("ht40_km", F.lit(0.0)))
    cut = exact_percentiles(df.where("ht40_km > 0"), ("surf",), "ht40_km", {"threshold": prob}).drop("n")
    # of the absolute cuts only that of ``ht40_km`` is taken; the other columns need not be there
    ext_abs = is_extreme_abs("ht40_km", "ht40_km", "ht40_km", "ht40_km")["ht40"].cast("int")
    # one row per surface type
    return df.withColumn("ext_abs", ext_abs).join(F.broadcast(cut), "surf", "left").withColumn(
        "ext_pct", F.coalesce((F.col("ht40_km") >= F.col("threshold")).cast("int"), F.lit(0))
    )


def prevalence(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.avg("ext_abs").alias("prev_abs"), F.avg("ext_pct").alias("prev_pct"), F.count("*").alias("n")
    )


def extreme_environment(labelled: DataFrame, predictors=C.PREDICTORS, label: str = "ext_pct") -> DataFrame:
    """Quartiles of every predictor among extreme and typical features."""
    pairs = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("value")) for p in predictors])
    values = labelled.select(F.col(label).alias("extreme"), F.explode(pairs).alias("p")).select(
        "extreme", "p.predictor", "p.value"
    )
    return exact_percentiles(values, ("extreme", "predictor"), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
