"""Radar-shaped inputs derived from general-purpose tables by plain arithmetic.

Used by the registered queries, the benchmark and the tests. Every column is a
fixed formula of a source row, so another SQL engine can repeat it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom import schemas
from rainloom.functions.scalars import bin_heights, encode_feature_id, int_div
from rainloom.session import HUGE_METHODS, materialize

RAYS = 49
SCANS = 50
VERTICAL = ("dbz_bins", "height_bins", "rate_bins")


def cents(col: str) -> F.Column:
    return F.round(F.col(col) * 100).cast("long")


def _spread(df: DataFrame) -> DataFrame:
    """A small source file is one task; the formulas below deserve all cores. A large one has tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def swath_pixels(events: DataFrame) -> DataFrame:
    """One radar pixel per event: 50 scans x 49 rays per orbit."""
    v = F.col("v")
    ray, scan, orbit = F.col("ray"), F.col("scan"), F.col("orbit")
    df = _spread(events).select(
        F.col("event_id").alias("e"),
        cents("value").alias("v"),
        "user_id",
        "event_type",
        F.date_trunc("year", F.col("ts").cast("timestamp")).alias("year0"),
    ).withColumns(
        {
            "orbit": int_div("e", RAYS * SCANS).cast("int"),
            "scan": int_div(F.pmod("e", F.lit(RAYS * SCANS)), RAYS).cast("int"),
            "ray": F.pmod("e", F.lit(RAYS)).cast("int"),
        }
    )
    # Orbit pairs (one per mission) share a place; the third place lies on the antimeridian.
    place = F.pmod(int_div(orbit, 2), F.lit(3))
    lon0 = F.when(place == 0, F.lit(10)).when(place == 1, F.lit(178)).otherwise(F.lit(-91))
    lat0 = F.when(place == 0, F.lit(4)).when(place == 1, F.lit(-12)).otherwise(F.lit(31))
    lon_milli = lon0 * 1000 + ray * 40 + 13
    # The first orbit starts 40 minutes before a month ends.
    micros = (
        F.unix_micros("year0")
        - F.lit(2_400_000_000)
        + orbit.cast("long") * F.lit(864_000_000_000 + 3_600_000_000)
        + scan.cast("long") * F.lit(97_000_000)
    )
    top = F.least(int_div(v, 200), F.lit(150)).cast("int")
    above_ground = lambda b: F.lit(175) - b
    dbz = F.transform(
        F.sequence(F.lit(0), F.lit(175)),
        lambda b: F.when(
            above_ground(b) <= top,
            (F.lit(460) - above_ground(b) * 2 + F.pmod(v, F.lit(7)) * 10).cast("double") / 10.0,
        ),
    )
    rate = F.transform(
        F.sequence(F.lit(0), F.lit(175)),
        lambda b: F.when(
            above_ground(b) <= top, F.pmod(above_ground(b) * 7 + v, F.lit(23)).cast("double") / 2.0
        ),
    )
    return df.select(
        F.when(F.pmod(orbit, F.lit(2)) == 0, F.lit("GPM")).otherwise(F.lit("TRMM")).alias("mission"),
        "orbit",
        "scan",
        "ray",
        ((lat0 * 1000 + scan * 40 + 13).cast("double") / 1000.0).alias("lat"),
        (F.when(lon_milli >= 180000, lon_milli - 360000).otherwise(lon_milli).cast("double") / 1000.0).alias("lon"),
        F.timestamp_micros(micros).alias("time"),
        F.when(F.pmod(v, F.lit(97)) != 0, F.least(v - 4800, F.lit(6000)).cast("double") / 100.0).alias("near_sfc_dbz"),
        F.when(F.pmod(v, F.lit(50)) == 7, F.lit(None))
        .when(v < 2000, F.lit(0.0))
        .otherwise(v.cast("double") / 400.0)
        .alias("near_sfc_rain"),
        F.when(F.col("event_type") == "view", F.lit(1))
        .when(F.col("event_type") == "purchase", F.lit(1))
        .when(F.col("event_type") == "click", F.lit(2))
        .when(F.col("event_type") == "error", F.lit(2))
        .when(F.pmod(v, F.lit(2)) == 0, F.lit(3))
        .otherwise(F.lit(-1))
        .alias("rain_type"),
        (F.pmod(F.col("user_id"), F.lit(21)) * 20 - 20).cast("int").alias("surface_type"),
        F.when(F.pmod(v, F.lit(11)) != 3, (F.lit(80) + F.pmod(v, F.lit(41))).cast("double") / 100.0).alias("epsilon"),
        F.when(F.pmod(v, F.lit(13)) != 5, (F.lit(120) + F.pmod(v, F.lit(53))).cast("double") / 4.0).alias("nw"),
        F.when(F.pmod(v, F.lit(17)) != 2, (F.lit(18) + F.pmod(v, F.lit(29))).cast("double") / 20.0).alias("dm"),
        F.when(F.pmod(v, F.lit(3)) == 0, (F.lit(4000) + F.pmod(F.col("e"), F.lit(13)) * 50).cast("double")).alias("bb_height"),
        (F.lit(4500) + F.pmod(F.col("e"), F.lit(7)) * 100).cast("double").alias("freezing_level"),
        F.when(F.pmod(v, F.lit(19)) != 4, (F.lit(2000) + F.pmod(v * 3, F.lit(13700))).cast("double")).alias("storm_top"),
        (F.pmod(v, F.lit(100)).cast("double") / 100.0).alias("pia"),
        (F.abs(ray - 24).cast("double") * 0.75).alias("local_zenith"),
        dbz.alias("dbz_bins"),
        rate.alias("rate_bins"),
        F.when(F.pmod(v, F.lit(5)) == 0, (F.lit(40) + F.pmod(v, F.lit(20))).cast("int")).otherwise(F.lit(-9999)).alias(
            "bin_mirror_image"
        ),
    ).withColumn("height_bins", bin_heights("local_zenith"))


def imager_pixels(events: DataFrame) -> DataFrame:
    """Microwave pixels: the radar lattice shifted by a fraction, two channels.

    Channel temperatures are formulas of the event; the 37 GHz channel has its own geolocation.
    """
    base = swath_pixels(events).select("mission", "orbit", "scan", "ray", "lat", "lon")
    e = F.col("orbit").cast("long") * RAYS * SCANS + F.col("scan") * RAYS + F.col("ray")
    out = base.withColumn("e", e).withColumn("channel", F.explode(F.array(F.lit("85_89"), F.lit("37"))))
    shift = F.when(F.col("channel") == "37", F.lit(0.021)).otherwise(F.lit(0.009))
    tc_v = (F.lit(2500) + F.pmod(F.col("e") * 31, F.lit(400))).cast("double") / 10.0
    tc_h = (F.lit(2300) + F.pmod(F.col("e") * 17, F.lit(300))).cast("double") / 10.0
    # The sub-satellite track runs ahead of the scan line on even places, behind it on odd ones.
    ahead = F.when(F.pmod(int_div("orbit", 2), F.lit(2)) == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    lat0 = F.col("lat") - 0.04 * F.col("scan")
    return out.select(
        "mission",
        "orbit",
        "channel",
        "scan",
        "ray",
        (F.col("lat") + shift).alias("lat"),
        F.when(F.col("lon") + shift >= 180.0, F.col("lon") + shift - 360.0).otherwise(F.col("lon") + shift).alias("lon"),
        F.when(F.pmod(F.col("e"), F.lit(41)) == 7, F.lit(-9999.0)).otherwise(tc_v).alias("tc_v"),
        tc_h.alias("tc_h"),
        (lat0 + 0.04 * F.col("scan") + ahead).alias("sc_lat"),
        (F.col("lon") - 0.04 * F.col("ray") + 0.96).alias("sc_lon"),
    )


def catalogue_features(orders: DataFrame) -> DataFrame:
    """A feature catalogue with environment columns: one feature per order."""
    t, k, c = F.col("t"), F.col("k"), F.col("c")
    df = orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), cents("o_totalprice").alias("t"), "o_orderdate"
    )

    def mod(x, n):
        return F.pmod(x, F.lit(n))

    def dec(x, d):
        return x.cast("double") / float(d)

    x = mod(t, 601)
    df = df.withColumns(
        {
            "mission": F.when(mod(k, 3) == 0, F.lit("TRMM")).otherwise(F.lit("GPM")),
            "orbit": int_div(k, 1000).cast("int"),
            "local_label": (mod(k, 1000) + 1).cast("int"),
            "time": F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + mod(t, 1440) * F.lit(60_000_000)),
            "npixels": (mod(t, 97) + 1).cast("int"),
            "area_km2": dec(x * x + 100, 100),
            "centroid_lat": dec(mod(t * 7, 8000), 100) - 40.0 + 0.003,
            "centroid_lon": dec(mod(t * 13, 36000), 100) - 180.0 + 0.003,
            "rate": dec(mod(int_div(t, 7), 600), 20),
            "frac_ocean": F.when(mod(k, 53) != 0, dec(mod(k, 11), 10)),
            "frac_land": F.when(mod(k, 53) != 0, dec((F.lit(10) - mod(k, 11)) * mod(k, 3), 20)),
            "max_ht_20dbz": F.when(mod(k, 29) != 0, (F.lit(2000) + mod(t, 180) * 100).cast("double")),
            "major_axis_km": dec(x, 4),
            "min_pct_85_89": F.when(mod(k, 17) != 0, dec(F.lit(800) + mod(int_div(t, 11), 2200), 10)),
            "min_pct_37": F.when(mod(k, 19) != 0, dec(F.lit(1400) + mod(int_div(t, 13), 1400), 10)),
            "conv_area_km2": dec((x * x + 100) * mod(c, 11), 2000),
            "strat_area_km2": dec((x * x + 100) * (F.lit(10) - mod(c, 11)), 2000),
            "p90_cape_2p50deg": F.when(mod(k, 31) != 0, dec(mod(int_div(t, 3), 55000), 10)),
            "shear_6000m_centroid": dec(mod(c * 31 + int_div(t, 5), 3300), 100),
            "shear_3000m_centroid": dec(mod(c * 17 + int_div(t, 9), 2100), 100),
            "shear_1000m_centroid": dec(mod(c * 7 + int_div(t, 15), 900), 100),
            "mean_cin_2p50deg": F.when(mod(k, 7) != 0, dec(-mod(t, 300), 2)),
            "mean_tpr_2p50deg": dec(mod(int_div(t, 17), 100), 10000),
            "mean_skt_2p50deg": dec(F.lit(2800) + mod(int_div(t, 19), 300), 10),
        }
    )
    df = df.withColumns(
        {
            "feature_id": encode_feature_id("mission", "orbit", "local_label"),
            "max_ht_30dbz": F.when(mod(k, 5) != 0, F.col("max_ht_20dbz") - 1000.0 - mod(c, 10).cast("double") * 100.0),
            "max_ht_40dbz": F.when(
                mod(int_div(k, 3), 3) != 0, F.col("max_ht_20dbz") - 1500.0 - mod(c, 20).cast("double") * 25.0
            ),
            "volrain_total": F.col("area_km2") * F.col("rate"),
            "is_mcs": F.col("area_km2") >= 2000.0,
        }
    )
    df = df.withColumns(
        {
            "volrain_conv": F.col("volrain_total") * dec(mod(c, 11), 10),
            "volrain_strat": F.col("volrain_total") * dec(F.lit(10) - mod(c, 11), 10) * 0.9,
            "conv_area_frac": F.col("conv_area_km2") / F.col("area_km2"),
            "strat_area_frac": F.col("strat_area_km2") / F.col("area_km2"),
            "feature_class": F.when(F.col("is_mcs"), F.lit("MCS"))
            .when(F.col("conv_area_km2") > 0, F.lit("sub_MCS_conv"))
            .when(F.col("strat_area_km2") > 0, F.lit("stratiform_only"))
            .otherwise(F.lit("weak")),
        }
    )
    return df.drop("k", "c", "t", "rate", "o_orderdate")


def catalogue_pixels(lineitem: DataFrame) -> DataFrame:
    """Member pixels of the catalogue features: one per line item, keyed to its order."""

    def mod(x, n):
        return F.pmod(x, F.lit(n))

    k, p, q = F.col("k"), F.col("p"), F.col("q")
    df = lineitem.select(
        F.col("l_orderkey").alias("k"),
        cents("l_extendedprice").alias("p"),
        F.col("l_quantity").cast("long").alias("q"),
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
    ).withColumns(
        {
            "mission": F.when(mod(k, 3) == 0, F.lit("TRMM")).otherwise(F.lit("GPM")),
            "orbit": int_div(k, 1000).cast("int"),
            "local_label": (mod(k, 1000) + 1).cast("int"),
        }
    )
    return df.select(
        encode_feature_id("mission", "orbit", "local_label").alias("feature_id"),
        "mission",
        "orbit",
        F.col("l_partkey").cast("int").alias("scan"),
        mod(F.col("l_suppkey"), 49).cast("int").alias("ray"),
        (mod(p, 4000).cast("double") / 100.0 - 20.0 + 0.003).alias("lat"),
        (mod(int_div(p, 7), 12000).cast("double") / 100.0 - 60.0 + 0.003).alias("lon"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + mod(p, 1440) * F.lit(60_000_000)).alias("time"),
        F.when(q == 13, F.lit(None))
        .when(mod(q, 4) == 0, F.lit(0.0))
        .otherwise(mod(int_div(p, 11), 5000).cast("double") / 40.0)
        .alias("near_sfc_rain"),
        F.when(mod(q, 5).isin(0, 2), F.lit(1))
        .when(mod(q, 5) == 1, F.lit(2))
        .when(mod(q, 5) == 3, F.lit(3))
        .otherwise(F.lit(-1))
        .alias("rain_type"),
    )


@dataclass
class Inputs:
    """Tables of one data directory, and what Spark derives from them (written once per session)."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def profiles(self) -> DataFrame:
        """The swath as formulas, stored nowhere: its arrays are built for the pixels that a reader keeps."""
        raw = schemas.conform(swath_pixels(self.table("events")), schemas.SWATH)
        # area and temperatures live in the narrow side table
        return raw.drop("pixel_area", "pct_85_89", "pct_37")

    @cached_property
    def swath(self) -> DataFrame:
        return materialize(self.profiles, "swath")

    @cached_property
    def flat(self) -> DataFrame:
        """The swath without its vertical arrays, which are nearly all of its work and bytes."""
        return materialize(self.profiles.drop(*VERTICAL), "flat")

    @cached_property
    def geolocation(self) -> DataFrame:
        """Full-precision positions with the columns of the parallax gate."""
        cols = ["mission", "orbit", "scan", "ray", "lat", "lon", "storm_top", "pia"]
        return materialize(swath_pixels(self.table("events")).select(*cols), "geolocation")

    @cached_property
    def side(self) -> DataFrame:
        from rainloom.operators.colocate import pixel_context

        return materialize(pixel_context(self.geolocation, self.imager), "side")

    @cached_property
    def imager(self) -> DataFrame:
        from rainloom.operators.colocate import imager_pct

        return materialize(imager_pct(imager_pixels(self.table("events"))), "imager")

    @cached_property
    def labels(self) -> DataFrame:
        from rainloom.operators.labels import label_features

        return materialize(label_features(self.flat, areas=self.side), "labelled")

    @cached_property
    def members(self) -> DataFrame:
        from rainloom.operators.features import join_members

        return materialize(join_members(self.profiles, self.labels, self.side), "members")

    @cached_property
    def swath_features(self) -> DataFrame:
        from rainloom.operators.features import build_features

        return materialize(build_features(self.flat, self.labels, self.members), "features")

    @cached_property
    def features(self) -> DataFrame:
        return materialize(catalogue_features(_spread(self.table("orders"))), "catalogue")

    @cached_property
    def pixels(self) -> DataFrame:
        return materialize(catalogue_pixels(_spread(self.table("lineitem"))), "catalogue-pixels")


_inputs: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(HUGE_METHODS, "8000")
    key = (spark.sparkContext.applicationId, folder)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, folder)
    return _inputs[key]
