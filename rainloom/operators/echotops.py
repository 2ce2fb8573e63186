"""Echo-top heights, raw and quality controlled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.scalars import is_number
from rainloom.session import growing, materialize

PIXEL = ["mission", "orbit", "scan", "ray"]
FEATURE = ["mission", "orbit", "local_label"]


def _echo_bins(threshold: float) -> Column:
    """Bins at or above ``threshold`` as array<struct(h, nb, rate)>; nb = -bin."""
    cells = F.transform(
        F.col("dbz_bins"),
        lambda z, b: F.when(
            ~F.isnan(z) & (z >= threshold) & ~F.isnan(F.get(F.col("height_bins"), b)),
            F.struct(
                F.get(F.col("height_bins"), b).cast("double").alias("h"),
                (-b).alias("nb"),
                z.cast("double").alias("z"),
            ),
        ),
    )
    return F.array_compact(cells)


def with_echo_columns(swath: DataFrame) -> DataFrame:
    """Reduce the vertical arrays of each pixel to the few numbers the echo tops need.

    ``above_T`` / ``below_T``: highest kept bin struct(h, nb) above / not above the floor;
    ``cut_sidelobe`` / ``cut_mirror``: the two geometric gates removed a 20 dBZ bin;
    ``dd``: the rate peaks at the top bin. The arrays are dropped, so nothing wide is shuffled.
    """
    outer = (F.col("ray") < C.INNER_RAY_LO) | (F.col("ray") > C.INNER_RAY_HI)
    mirror_bin = F.col("bin_mirror_image")
    mirror_raw = F.when(
        (mirror_bin >= 0) & (mirror_bin < F.size("height_bins")), F.get("height_bins", mirror_bin).cast("double")
    )
    mirror_h = F.when(is_number(mirror_raw), mirror_raw).otherwise(F.lit(float("inf")))

    df = (
        swath.withColumn("mirror_h", mirror_h)
        .withColumn("outer", outer)
        .withColumn("echo", _echo_bins(float(min(C.ECHO_THRESHOLDS))))
    )
    floor = F.lit(C.TOP_FLOOR_M)
    df = df.withColumn("high", F.filter("echo", lambda e: e["h"] > floor)).withColumn(
        "low", F.filter("echo", lambda e: e["h"] <= floor)
    )
    kept_high = F.when(~F.col("outer"), F.filter("high", lambda e: e["h"] <= F.col("mirror_h")))
    df = df.withColumn("kept", kept_high)

    least = min(C.ECHO_THRESHOLDS)

    def highest(bins: str, threshold: int) -> Column:
        # echoes are at the least threshold or above, and no two have the same height and bin
        strong = F.col(bins) if threshold == least else F.filter(bins, lambda e: e["z"] >= float(threshold))
        return F.array_max(strong)

    cols = []
    for t in C.ECHO_THRESHOLDS:
        cols += [highest("kept", t).alias(f"above_{t}"), highest("low", t).alias(f"below_{t}")]
    has_high = F.size("high") > 0
    df = df.select(
        *[c for c in swath.columns if c not in ("dbz_bins", "height_bins", "rate_bins")],
        *cols,
        (has_high & F.col("outer")).alias("cut_sidelobe"),
        F.exists("high", lambda e: e["h"] > F.col("mirror_h")).alias("cut_mirror"),
        # only pixels with a kept bin above the floor need the rate test
        F.when(F.size("kept") > 0, F.struct("height_bins", "rate_bins")).alias("rate_profile"),
    )
    df = df.withColumns({c: F.col(c).dropFields("z") for t in C.ECHO_THRESHOLDS for c in (f"above_{t}", f"below_{t}")})
    top_bin = -F.col("above_20.nb")
    rates = F.col("rate_profile.rate_bins")
    top_rate = F.get(rates, top_bin)
    others = F.array_max(
        F.transform(
            rates,
            lambda r, b: F.when(
                ~F.isnan(r) & (b != top_bin) & (F.get(F.col("rate_profile.height_bins"), b) > C.TOP_FLOOR_M), r
            ),
        )
    )
    dd = ~F.isnan(top_rate) & (top_rate >= others)
    return df.withColumn("dd", F.coalesce(dd, F.lit(False))).drop("rate_profile", "bin_mirror_image")


def pixel_echo_tops(swath: DataFrame, thresholds=C.ECHO_THRESHOLDS) -> DataFrame:
    """Per-pixel top after the geometric gates (no feature context): ``top_T``."""
    df = with_echo_columns(swath)
    for t in thresholds:
        df = df.withColumn(f"top_{t}", F.greatest(f"above_{t}.h", f"below_{t}.h").cast("float"))
    drop = [f"{side}_{t}" for t in C.ECHO_THRESHOLDS for side in ("above", "below")]
    return df.drop(*drop, "cut_sidelobe", "cut_mirror", "dd")


def raw_echo_tops(members: DataFrame, thresholds=C.ECHO_THRESHOLDS) -> DataFrame:
    """Highest bin at each threshold over the feature, with the pixel it came from."""
    aggs = []
    for t in thresholds:
        top = F.array_max(
            F.transform(
                F.col("dbz_bins"),
                lambda z, b: F.when(
                    ~F.isnan(z) & (z >= float(t)), F.get(F.col("height_bins"), b).cast("double")
                ),
            )
        )
        aggs.append(
            F.max(
                F.when(
                    top.isNotNull(), F.struct(top.alias("h"), (-F.col("scan")).alias("s"), (-F.col("ray")).alias("r"))
                )
            ).alias(f"t{t}")
        )
    out = members.groupBy(*FEATURE).agg(*aggs)
    for t in thresholds:
        out = (
            out.withColumn(f"raw_ht_{t}dbz", F.col(f"t{t}.h"))
            .withColumn(f"raw_ht_{t}dbz_scan", F.coalesce(-F.col(f"t{t}.s"), F.lit(-1)))
            .withColumn(f"raw_ht_{t}dbz_ray", F.coalesce(-F.col(f"t{t}.r"), F.lit(-1)))
            .drop(f"t{t}")
        )
    return out


def isolated(candidates: DataFrame, swath: DataFrame, neighbour_m: float = C.NEIGHBOUR_TOP_M) -> DataFrame:
    """(pixel key, isolated) for the candidate pixels.

    Isolated: some of the 8 neighbours has a storm top and none is above ``neighbour_m``.
    Only the candidates are spread to their neighbours, so the swath is read once, narrow.
    """
    offsets = F.array(
        *[F.struct(F.lit(ds).alias("ds"), F.lit(dr).alias("dr")) for ds in (-1, 0, 1) for dr in (-1, 0, 1) if ds or dr]
    )
    around = candidates.select(*PIXEL, F.explode(offsets).alias("o")).select(
        "mission",
        "orbit",
        (F.col("scan") + F.col("o.ds")).alias("scan"),
        (F.col("ray") + F.col("o.dr")).alias("ray"),
        F.col("scan").alias("scan0"),
        F.col("ray").alias("ray0"),
    )
    tops = swath.where(is_number("storm_top")).select(*PIXEL, "storm_top")
    return (
        around.join(growing(tops), PIXEL)
        .groupBy("mission", "orbit", F.col("scan0").alias("scan"), F.col("ray0").alias("ray"))
        .agg((F.max("storm_top") <= neighbour_m).alias("isolated"))
    )


def obs_ceiling() -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for mission, metres in C.OBS_CEILING_M.items():
        out = out.when(F.upper(F.col("mission")) == mission, F.lit(metres))
    return out.otherwise(F.lit(C.OBS_CEILING_DEFAULT_M))


def top_struct(t: int, side: str) -> Column:
    """Order by height, then first scan, ray and bin."""
    bins = F.col(f"{side}_{t}")
    return F.when(
        bins.isNotNull(),
        F.struct(
            bins["h"].alias("h"), (-F.col("scan")).alias("s"), (-F.col("ray")).alias("r"), bins["nb"].alias("nb")
        ),
    )


def below_aggregates() -> list[Column]:
    """Aggregates over all member pixels that need no ranking."""
    return [
        *[F.max(top_struct(t, "below")).alias(f"low_{t}") for t in C.ECHO_THRESHOLDS],
        F.bool_or("cut_sidelobe").alias("any_sidelobe"),
        F.bool_or("cut_mirror").alias("any_mirror"),
    ]


def qc_high_tops(members: DataFrame, swath: DataFrame) -> DataFrame:
    """Per feature with a kept echo above the floor: peel count and best unpeeled high tops.

    Pixels are tried from the highest down; an isolated one is peeled, at most
    ``MAX_PEEL + 1`` times. Only those first few pixels of a feature are ever ranked.
    """
    tries = C.MAX_PEEL + 1
    high = members.where(F.col("above_20").isNotNull())
    order = Window.partitionBy(*FEATURE).orderBy(F.col("above_20.h").desc(), "scan", "ray")
    first = (
        high.select(*PIXEL, "local_label", "above_20", "dd")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= tries)
    )
    first = materialize(first, "high-tops")
    flags = isolated(first, swath)
    first = first.join(growing(flags), PIXEL, "left").withColumn("isolated", F.coalesce("isolated", F.lit(False)))
    verdict = (
        first.groupBy(*FEATURE)
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(~F.col("isolated"), F.struct("rank", "dd"))).alias("hit"),
        )
        .select(
            *FEATURE,
            F.coalesce(F.col("hit.rank") - 1, F.col("n")).alias("peeled"),
            F.col("hit.dd").alias("top_dd"),
            (F.col("hit").isNull() & (F.col("n") >= tries)).alias("gave_up"),
        )
    )
    removed = (
        first.join(growing(verdict), FEATURE).where(F.col("rank") <= F.col("peeled")).select(*PIXEL)
    )
    best = (
        high.join(growing(removed), PIXEL, "left_anti")
        .groupBy(*FEATURE)
        .agg(*[F.max(top_struct(t, "above")).alias(f"high_{t}") for t in C.ECHO_THRESHOLDS])
    )
    return verdict.join(growing(best), FEATURE, "left")


def finish_tops(df: DataFrame) -> DataFrame:
    """Combine the low and high parts into heights, provenance, flags and censoring."""
    gave_up = F.coalesce("gave_up", F.lit(False))
    peeled = F.coalesce("peeled", F.lit(0))
    for t in C.ECHO_THRESHOLDS:
        df = df.withColumn(f"best_{t}", F.when(~gave_up, F.greatest(f"high_{t}", f"low_{t}")))
    has_top = F.col("best_20").isNotNull()
    for t in C.ECHO_THRESHOLDS:
        best = F.when(has_top, F.col(f"best_{t}"))
        df = (
            df.withColumn(f"max_ht_{t}dbz", best["h"])
            .withColumn(f"max_ht_{t}dbz_scan", F.coalesce(-best["s"], F.lit(-1)))
            .withColumn(f"max_ht_{t}dbz_ray", F.coalesce(-best["r"], F.lit(-1)))
        )
    ceiling = obs_ceiling()
    above = F.coalesce(F.col("max_ht_20dbz") > C.TOP_FLOOR_M, F.lit(False))
    dd = above & F.coalesce("top_dd", F.lit(False))
    reached = above & (F.col("max_ht_20dbz") >= ceiling - C.CENSOR_BIN_TOL * C.BIN_SIZE_M)

    def bit(cond: Column, value: int) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0))

    # A top above the floor is accepted only when it is not isolated, so that bit stays clear.
    flags = (
        bit(F.coalesce("any_sidelobe", F.lit(False)), C.FLAG_SIDELOBE)
        + bit(F.coalesce("any_mirror", F.lit(False)), C.FLAG_MIRROR)
        + bit(peeled > 0, C.FLAG_PEELED)
        + bit(dd, C.FLAG_DD_FROM_TOP)
        + bit(reached, C.FLAG_TRUNCATED | C.FLAG_CENSORED)
        + bit(dd & reached, C.FLAG_OVERSHOOT)
    )
    return (
        df.withColumn("echotop_qc_flags", flags)
        .withColumn("max_ht_20dbz_censored", reached)
        .withColumn("ray_obs_ceiling_m", F.when(has_top, ceiling))
    )


def qc_echo_tops(members: DataFrame, swath: DataFrame) -> DataFrame:
    """QC'd 20/30/40 dBZ tops per feature. ``members`` carry the echo columns."""
    low = members.groupBy(*FEATURE).agg(*below_aggregates())
    out = finish_tops(low.join(growing(qc_high_tops(members, swath)), FEATURE, "left"))
    heights = [f"max_ht_{t}dbz{s}" for t in C.ECHO_THRESHOLDS for s in ("", "_scan", "_ray")]
    return out.select(*FEATURE, *heights, "echotop_qc_flags", "max_ht_20dbz_censored", "ray_obs_ceiling_m")
