"""Annual maps: 27 quantities for GPM, TRMM and the pooled record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.ranking import exact_percentiles
from rainloom.operators.sets import combined_member

CELL = ["lat_bin", "lon_bin"]
MEMBERS = ("GPM", "TRMM", "COMBINED")
QUANTITIES = (
    "rain", "raining_views", "views", "rate", "freq", "intensity",
    "conv_rain", "strat_rain", "conv_freq", "strat_freq", "conv_intensity", "strat_intensity",
    "conv_rain_frac", "conv_pixel_frac", "echotop20", "echotop30", "echotop40",
    "freq_gt25", "freq_gt50", "freq_gt75", "freq_gt100",
    "eps_conv", "eps_strat", "nw_conv", "nw_strat", "dm_conv", "dm_strat",
)
TOTALS = ("rain_sum", "raining", "conv_rain_sum", "conv_raining", "strat_rain_sum", "strat_raining", "n_views")
_STRAT, _CONV = 0, 1


def annual_totals(
    rain: DataFrame, views: DataFrame, metrics: DataFrame | None = None, by: tuple = ("mission",)
) -> DataFrame:
    """Sums over month, hour and class per cell, every cell that was viewed, rained or measured.

    The three inputs are stacked and added up once, so one shuffle serves all of them.
    """

    def of_type(col: str, kind: int) -> Column:
        return F.when(F.col("raintype") == kind, F.col(col))

    keys = [*by, *CELL]
    parts = [
        rain.select(
            *keys,
            F.col("rain_sum"),
            F.col("raining_count").alias("raining"),
            of_type("rain_sum", _CONV).alias("conv_rain_sum"),
            of_type("raining_count", _CONV).alias("conv_raining"),
            of_type("rain_sum", _STRAT).alias("strat_rain_sum"),
            of_type("raining_count", _STRAT).alias("strat_raining"),
        ),
        views.select(*keys, "n_views"),
    ]
    sums = list(TOTALS)
    if metrics is not None:
        parts.append(metrics.select(*keys, *C.METRIC_COLS))
        sums += C.METRIC_COLS
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def pooled_members(totals: DataFrame, band=C.SHARED_LAT_CLIP, deg: float = C.GRID_DEG) -> DataFrame:
    values = [c for c in totals.columns if c not in ("mission", *CELL)]
    return combined_member(totals, values, band=band, deg=deg)


def _ratio(a: Column, b: Column, mask: Column) -> Column:
    return F.when(mask, F.try_divide(a, b))


def derive_quantities(
    totals: DataFrame, min_views: int = C.MIN_VIEWS, min_samples: int = C.MIN_SAMPLES
) -> DataFrame:
    """All quantities of a table of totals; a quantity whose mask fails is null."""
    c = F.col
    views = c("n_views")
    seen = views >= min_views
    year = F.lit(C.HOURS_PER_YEAR)
    out: dict[str, Column] = {
        "rain": _ratio(c("rain_sum"), views, seen) * year,
        "raining_views": F.when(seen, c("raining")),
        "views": views,
        "rate": _ratio(c("rain_sum"), views, seen),
        "freq": _ratio(c("raining"), views, seen),
        "intensity": _ratio(c("rain_sum"), c("raining"), c("raining") >= 1),
        "conv_rain_frac": _ratio(c("conv_rain_sum"), c("rain_sum"), seen & (c("rain_sum") > 0)),
        "conv_pixel_frac": _ratio(c("conv_raining"), c("raining"), c("raining") >= 1),
    }
    for kind in ("conv", "strat"):
        rain_sum, raining = c(f"{kind}_rain_sum"), c(f"{kind}_raining")
        out[f"{kind}_rain"] = _ratio(rain_sum, views, seen) * year
        out[f"{kind}_freq"] = _ratio(raining, views, seen)
        out[f"{kind}_intensity"] = _ratio(rain_sum, raining, raining >= 1)
    if "et20_sum" in totals.columns:

        def mean(name: str) -> Column:
            return _ratio(c(f"{name}_sum"), c(f"{name}_n"), c(f"{name}_n") >= min_samples)

        for t in C.ECHO_THRESHOLDS:
            out[f"echotop{t}"] = mean(f"et{t}")
        for t in C.RAIN_THRESHOLDS:
            out[f"freq_gt{t}"] = _ratio(c(f"cnt_gt{t}"), views, seen)
        for kind in ("conv", "strat"):
            out[f"eps_{kind}"] = mean(f"eps_{kind}")
            # stored as dBNw; a tenth of it is log10(Nw)
            out[f"nw_{kind}"] = mean(f"nw_{kind}") / 10.0
            out[f"dm_{kind}"] = mean(f"dm_{kind}")
    keys = [k for k in totals.columns if k in ("member", "mission", *CELL)]
    return totals.select(*keys, *[out[q].alias(q) for q in QUANTITIES if q in out])


def annual_fields(rain, views, metrics, deg: float = C.GRID_DEG, band=C.SHARED_LAT_CLIP, **masks) -> DataFrame:
    """Grid tables to the quantities of all three members."""
    return derive_quantities(pooled_members(annual_totals(rain, views, metrics), band, deg), **masks)


def pivot_members(fields: DataFrame) -> DataFrame:
    """One row per cell with the 81 columns ``{member}_{quantity}``."""
    values = [q for q in QUANTITIES if q in fields.columns]
    wide = fields.groupBy(*CELL).pivot("member", list(MEMBERS)).agg(*[F.first(q).alias(q) for q in values])
    return wide.select(*CELL, *[f"{m}_{q}" for m in MEMBERS for q in values])


def long_fields(fields: DataFrame) -> DataFrame:
    """(member, quantity, value) without the missing values."""
    values = [q for q in QUANTITIES if q in fields.columns]
    pairs = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).cast("double").alias("value")) for q in values])
    keys = [k for k in ("member", *CELL) if k in fields.columns]
    return fields.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.quantity", "p.value").where("value IS NOT NULL")


# Quantities that share one colour range over all members.
SHARED_RANGES = {
    "nw": ("nw_conv", "nw_strat"),
    "dm": ("dm_conv", "dm_strat"),
    "eps": ("eps_conv", "eps_strat"),
    "echotop": ("echotop20", "echotop30", "echotop40"),
}
NW_RANGE = {"vmin": 2.5, "vmax": 4.5, "dlo": 2.0, "dhi": 5.0}


def display_ranges(fields: DataFrame) -> DataFrame:
    """Colour range and slider domain per member and quantity."""
    values = long_fields(fields)
    own = exact_percentiles(
        values, ("member", "quantity"), "value", {"q001": 0.001, "q999": 0.999, "q9999": 0.9999}
    )
    group = F.lit(None).cast("string")
    for name, members in SHARED_RANGES.items():
        group = F.when(F.col("quantity").isin(*members), F.lit(name)).otherwise(group)
    pooled = exact_percentiles(
        values.withColumn("range_group", group).where("range_group IS NOT NULL AND range_group <> 'nw'"),
        ("range_group",),
        "value",
        {"g01": 0.01, "g99": 0.99},
    ).drop("n")
    df = own.withColumn("range_group", group).join(F.broadcast(pooled), "range_group", "left")
    lo, hi = F.col("q001"), F.col("q999")
    spread = hi > lo
    vmin = F.when(spread, lo).otherwise(0.0)
    vmax = F.when(spread | (hi > 0), hi).otherwise(1.0)
    is_nw, shared = F.col("range_group") == "nw", F.col("g99").isNotNull()
    dhi = F.greatest(F.col("q9999"), vmax * 1.05)
    return df.select(
        "member",
        "quantity",
        F.round(F.when(is_nw, F.lit(NW_RANGE["vmin"])).when(shared, F.col("g01")).otherwise(vmin), 6).alias("vmin"),
        F.round(F.when(is_nw, F.lit(NW_RANGE["vmax"])).when(shared, F.col("g99")).otherwise(vmax), 6).alias("vmax"),
        F.when(is_nw, F.lit(NW_RANGE["dlo"])).otherwise(0.0).alias("dlo"),
        F.round(F.when(is_nw, F.lit(NW_RANGE["dhi"])).when(shared, F.col("g99") * 1.05).otherwise(dhi), 6).alias("dhi"),
    )


def valid_max(fields: DataFrame) -> DataFrame:
    """99th percentile per field; 1 where that is not positive."""
    q = exact_percentiles(long_fields(fields), ("member", "quantity"), "value", {"p99": 0.99})
    return q.select("member", "quantity", F.when(F.col("p99") > 0, F.col("p99")).otherwise(1.0).alias("valid_max"))


def field(
    breakdown_rain: DataFrame,
    views: DataFrame,
    breakdown: str,
    cls: int | None,
    quantity: str,
    months=None,
    hours=None,
    min_views: int | None = None,
    percent: bool = False,
) -> DataFrame:
    """One quantity of one class per cell, over chosen months and hours.

    ``breakdown_rain``: breakdown, class, month, hour, cell, rain_sum, raining_count.
    """
    rain = breakdown_rain.where(F.col("breakdown") == breakdown)
    if cls is not None:
        rain = rain.where(F.col("class") == cls)
    for name, wanted in (("month", months), ("hour", hours)):
        if wanted is not None:
            rain, views = (d.where(F.col(name).isin([int(x) for x in wanted])) for d in (rain, views))
    stacked = rain.select(*CELL, "rain_sum", "raining_count").unionByName(
        views.select(*CELL, "n_views"), allowMissingColumns=True
    )
    total = stacked.groupBy(*CELL).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rain_sum", "raining_count", "n_views")]
    )
    r, n, v = F.col("rain_sum"), F.col("raining_count"), F.col("n_views")
    freq = F.try_divide(n, v)
    value = {
        "rain": r,
        "raining_views": n.cast("double"),
        "views": v.cast("double"),
        "rate": F.try_divide(r, v),
        "freq": freq * 100.0 if percent else freq,
        "intensity": F.try_divide(r, n),
    }[quantity]
    if min_views is not None:
        floor = 1 if quantity == "views" else min_views
        value = F.when(v >= floor, value)
    return total.select(*CELL, value.alias(quantity)).where(F.col(quantity).isNotNull())
