"""Granule inventory from file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C


def parse_granules(names: DataFrame, col: str = "name") -> DataFrame:
    """Add orbit, version and observation start / end parsed from the base name.

    An end before the start belongs to the next day; without an end the orbit is taken to
    last 100 minutes. Parts that are not in the name are null.
    """
    parts = {
        "_orbit": r"\.(\d{5,6})\.V\d+",
        "_version": r"\.V(\d{2}[A-Z]?)",
        "_day": r"\.(\d{8})-S\d{6}",
        "_from": r"\.\d{8}-S(\d{6})",
        "_to": r"-E(\d{6})",
    }
    # each pattern is tried once and each time read once: what is used twice is a column of its own
    named = names.withColumn("_base", F.regexp_extract(F.col(col), r"([^/]*)$", 1))
    found = named.withColumns({c: F.regexp_extract("_base", p, 1) for c, p in parts.items()}).drop("_base")
    timed = found.withColumns({"_start": _instant("_day", "_from"), "_end": _instant("_day", "_to")})
    end = F.when(F.col("_end") < F.col("_start"), F.col("_end") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("_end"))
    out = {
        "orbit": F.when(F.col("_orbit") != "", F.col("_orbit")).cast("int"),
        "version": F.when(F.col("_version") != "", F.col("_version")),
        "obs_start": F.col("_start"),
        "obs_end": F.coalesce(end, F.col("_start") + F.expr("INTERVAL 100 MINUTES")),
    }
    return timed.withColumns(out).drop(*parts, "_start", "_end")


def _instant(day: str, clock: str) -> Column:
    """The time of eight digits of a date and six of a time of day; null if either is absent or impossible."""
    digits = [(day, 1, 4), (day, 5, 2), (day, 7, 2), (clock, 1, 2), (clock, 3, 2), (clock, 5, 2)]
    time = F.try_make_timestamp(*[F.substring(c, at, n).cast("int") for c, at, n in digits])
    return F.when((F.length(day) == 8) & (F.length(clock) == 6), time)


def prefer_version(
    granules: DataFrame, versions: dict[str, str] | None = None, name: str = "name", by: tuple = ("mission", "orbit")
) -> DataFrame:
    """Keep the preferred version of each product, or everything where none has it.

    ``by`` says within what: each orbit for itself, or a search window, or () for the whole inventory.
    """
    versions = versions or C.PRODUCT_VERSION
    want = F.lit(C.PRODUCT_VERSION_DEFAULT)
    for product, version in versions.items():
        want = F.when(F.col("product") == product, F.lit(version)).otherwise(want)
    tagged = granules.withColumn("_hit", F.contains(F.col(name), F.concat(F.lit(".V"), want)))
    keys = ["product", *by]
    any_hit = tagged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.bool_or("_hit").alias("_any"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return tagged.join(any_hit, same).where(F.col("_hit") | ~F.col("_any")).select(*granules.columns)


def one_per_orbit(granules: DataFrame, seq: str = "seq", by: tuple = ("mission", "orbit")) -> DataFrame:
    """Last granule of each orbit in input order; names without an orbit are dropped."""
    rest = [c for c in granules.columns if c not in (seq, *by)]
    last = granules.where(F.col("orbit").isNotNull()).groupBy(*by).agg(F.max(F.struct(seq, *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in by else F.col(f"_last.{c}").alias(c) for c in granules.columns])


def pair_granules(radar: DataFrame, imager: DataFrame) -> DataFrame:
    """Every radar granule with its imager granule, if there is one."""
    return radar.select("mission", "orbit", F.col("name").alias("radar_name"), "obs_start", "obs_end").join(
        imager.select("mission", "orbit", F.col("name").alias("imager_name")), ["mission", "orbit"], "left"
    )


def orbits_starting_in(granules: DataFrame, first_day, last_day) -> DataFrame:
    """Granules whose start day lies in the inclusive range; an unknown start is kept."""
    day = F.to_date("obs_start")
    return granules.where(day.isNull() | day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def granule_months(granules: DataFrame, run: tuple | None = None) -> DataFrame:
    """One row per month a granule overlaps: start < month end and end > month start.

    A granule without a known span may belong to any month and gets all of ``run`` (first and last
    day), by default from the first start to the last end in the inventory.
    """
    # an end on the very first instant of a month does not overlap it
    last = F.greatest("obs_start", F.col("obs_end") - F.expr("INTERVAL 1 MICROSECOND"))
    months = F.sequence(F.trunc("obs_start", "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    known = granules.where("obs_start IS NOT NULL").withColumn("month_start", F.explode(months))
    if run is None:
        run = granules.agg(F.min("obs_start"), F.max(last)).first()
    first_month, last_month = (F.trunc(F.lit(x).cast("timestamp"), "MM") for x in run)
    anywhere = F.when(first_month.isNotNull(), F.sequence(first_month, last_month, F.expr("INTERVAL 1 MONTH")))
    unbounded = granules.where("obs_start IS NULL").withColumn("month_start", F.explode_outer(anywhere))
    both = known.unionByName(unbounded)
    return both.withColumns({"year": F.year("month_start"), "month": F.month("month_start")})
