"""Checks that return the offending rows: an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom import constants as C
from rainloom.functions.scalars import decode_feature_id, encode_feature_id, is_number, is_view


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns whose position, name or type differs from the schema."""
    have = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    want = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    spark = df.sparkSession
    kind = "position int, name string, type string"
    a, b = spark.createDataFrame(have, kind), spark.createDataFrame(want, kind)
    return (
        a.exceptAll(b).withColumn("problem", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("missing")))
    )


def integrity_violations(pixels: DataFrame, features: DataFrame) -> DataFrame:
    """Pixels without a feature, and features whose pixel count differs from ``npixels``."""
    counts = pixels.groupBy("feature_id").agg(F.count("*").alias("n"))
    both = counts.join(features.select("feature_id", "npixels"), "feature_id", "full_outer")
    return (
        both.withColumn(
            "problem",
            F.when(F.col("npixels").isNull(), F.lit("pixels without feature"))
            .when(F.col("n").isNull(), F.lit("feature without pixels"))
            .when(F.col("n") != F.col("npixels"), F.lit("count differs")),
        )
        .where(F.col("problem").isNotNull())
        .select("feature_id", "problem", F.col("n").alias("found"), F.col("npixels").cast("long").alias("expected"))
    )


def orphan_pixels(pixels: DataFrame, features: DataFrame) -> DataFrame:
    return pixels.join(features.select("feature_id"), "feature_id", "left_anti")


def check_conservation(swath: DataFrame, views: DataFrame, rain: DataFrame) -> DataFrame:
    """Views of each mission must add up to its valid pixels; no cell rains more often than it is seen."""
    valid = swath.where(is_view(ts="time")).groupBy("mission").agg(F.count("*").alias("pixels"))
    seen = views.groupBy("mission").agg(F.sum("n_views").alias("views"))
    totals = (
        valid.join(seen, "mission", "full_outer")
        .where(~F.col("pixels").eqNullSafe(F.col("views")))
        .select("mission", F.lit(None).cast("int").alias("lat_bin"), F.lit(None).cast("int").alias("lon_bin"),
                F.lit(None).cast("int").alias("hour"), F.lit("total").alias("problem"))
    )
    keys = ["mission", "lat_bin", "lon_bin", "hour"]
    wet = rain.groupBy(*keys).agg(F.sum("raining_count").alias("wet"))
    cells = (
        wet.join(views, keys, "left")
        .where(F.col("wet") > F.coalesce("n_views", F.lit(0)))
        .select("mission", *[F.col(k).cast("int").alias(k) for k in keys[1:]], F.lit("rain without view").alias("problem"))
    )
    return totals.unionByName(cells)


def check_ranges(features: DataFrame, min_area: float = C.MIN_AREA_KM2) -> DataFrame:
    """Features with an impossible position, size or identifier."""
    rules = {
        "latitude": F.col("centroid_lat").between(-90, 90),
        "longitude": F.col("centroid_lon").between(-180, 180),
        "npixels": F.col("npixels") > 0,
        "area": F.col("area_km2") >= min_area,
        "round trip": encode_feature_id("mission", "orbit", "local_label") == F.col("feature_id"),
        "decoded": decode_feature_id("feature_id")["local_label"] == F.col("local_label"),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return features.select("feature_id", F.explode(failed).alias("problem"))


def implausible(df: DataFrame, rule: Column) -> DataFrame:
    """The rows that a sanity rule (``sane_views``, ``sane_rain``, ``sane_metrics``) keeps out of the reductions."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def check_ranges_of_fields(ranges: DataFrame) -> DataFrame:
    """Colour ranges that leave their slider's domain, or that are upside down."""
    ok = (F.col("dlo") <= F.col("vmin")) & (F.col("vmin") <= F.col("vmax")) & (F.col("vmax") <= F.col("dhi"))
    return ranges.where(~F.coalesce(ok, F.lit(False))).withColumn("problem", F.lit("range outside domain"))


def check_fields(fields: DataFrame, by: tuple, value: str, expected: list[tuple] | None = None) -> DataFrame:
    """Published fields that are empty, negative, or whose quantiles leave the data range.

    ``expected`` lists the fields that must be there; one without any value is empty.
    """
    from rainloom.functions.ranking import exact_percentiles

    base = fields.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n_values"))
    q = exact_percentiles(fields, by, value, {"q001": 0.001, "q999": 0.999}).drop("n")
    joined = base.join(q, list(by), "left")
    if expected is not None:
        known = fields.select(*by).schema
        joined = fields.sparkSession.createDataFrame(expected, known).join(joined, list(by), "left").fillna(0, ["n_values"])
    problem = (
        F.when(F.col("n_values") == 0, F.lit("empty"))
        .when(F.col("lo") < -1e-6, F.lit("negative"))
        .when(
            ~((F.col("lo") <= F.col("q001")) & (F.col("q001") <= F.col("q999")) & (F.col("q999") <= F.col("hi") + 1e-6)),
            F.lit("quantiles not bracketed"),
        )
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())


def fingerprints(cols: list[str]) -> list[Column]:
    """n_rows and digest of a group: the sum of the hashes of its rows, which has no order and adds up over groups."""
    return [F.count("*").alias("n_rows"), F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")]


def reconcile(source: DataFrame, target: DataFrame, by: tuple = ("mission", "year", "month")) -> DataFrame:
    """Rows and digests (n_rows, digest) of partitions on both sides, with status ok / mismatch / missing / extra.

    Partitions with equal counts and different contents are a mismatch.
    """
    side = lambda df, name: df.select(*by, F.col("n_rows").alias(f"{name}_rows"), F.col("digest").alias(f"{name}_digest"))
    same = (F.col("source_rows") == F.col("target_rows")) & F.col("source_digest").eqNullSafe(F.col("target_digest"))
    status = (
        F.when(F.col("target_rows").isNull(), F.lit("missing"))
        .when(F.col("source_rows").isNull(), F.lit("extra"))
        .when(same, F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )
    return side(source, "source").join(side(target, "target"), list(by), "full_outer").withColumn("status", status)


def reconcile_tables(source: DataFrame, target: DataFrame, by: tuple = ("mission", "year", "month"), cols: list[str] | None = None) -> DataFrame:
    """The same from the rows themselves; ``cols`` are compared, by default all that the two have in common."""
    cols = cols or [c for c in source.columns if c in target.columns]
    return reconcile(*[df.groupBy(*by).agg(*fingerprints(cols)) for df in (source, target)], by)


def has_only_numbers(df: DataFrame, *cols: str) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~is_number(c), F.lit(c)) for c in cols]))
    return df.withColumn("problem", F.explode(bad))
