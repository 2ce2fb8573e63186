"""Hourly grid kept current as pixel files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from rainloom import constants as C
from rainloom.functions import scalars as S
from rainloom.schemas import SWATH
from rainloom.session import discard, materialize
from rainloom.sources.lake import exists


PIXEL = ["mission", "orbit", "scan", "ray"]


def hourly_grid(pixels: DataFrame, watermark: str | None = "1 day", deg: float = C.GRID_DEG) -> DataFrame:
    """Views and rain per hour, mission and cell.

    Works on a stream (late orbits are accepted up to the watermark) and on a batch alike;
    without ``watermark`` the stream must bring its own.
    Sums by rain type sit side by side, so one state row per cell and hour is enough.
    """
    views = pixels.where(S.is_view(ts="time")).withColumns(
        {"lat_bin": S.lat_bin("lat", deg), "lon_bin": S.lon_bin("lon", deg), "kind": S.raintype_class("rain_type")}
    )
    aggs = [F.count("*").alias("n_views")]
    for i, name in enumerate(C.RAINTYPE_LABELS):
        mine = (F.col("near_sfc_rain") > 0) & (F.col("kind") == i)
        aggs.append(F.sum(F.when(mine, F.col("near_sfc_rain").cast("double")).otherwise(0.0)).alias(f"{name}_sum"))
        aggs.append(F.count_if(mine).alias(f"{name}_count"))
    timed = views if watermark is None else views.withWatermark("time", watermark)
    return (
        timed
        .groupBy(F.window("time", "1 hour").alias("w"), "mission", "lat_bin", "lon_bin")
        .agg(*aggs)
        .select(F.col("w.start").alias("hour_start"), F.col("mission"), "lat_bin", "lon_bin", *_value_columns())
    )


_NARROW = [*PIXEL, "lat", "lon", "time", "near_sfc_rain", "rain_type"]
SWATH_NARROW = StructType([SWATH[c] for c in _NARROW])


def _delivered(spark: SparkSession, path: str, deg: float) -> DataFrame:
    """The hourly grid of all that has arrived so far, each pixel once."""
    pixels = spark.read.schema(SWATH).parquet(path).select(*_NARROW).dropDuplicates(PIXEL)
    return hourly_grid(pixels, deg=deg)


def open_hours(spark: SparkSession, path: str, out: str, deg: float = C.GRID_DEG) -> DataFrame:
    """Rows of the hours after the last one that the stream has written, computed from its input."""
    whole = _delivered(spark, path, deg)
    last = spark.read.schema(whole.schema).parquet(out).agg(F.max("hour_start")).first()[0]
    return whole if last is None else whole.where(F.col("hour_start") > F.lit(last).cast("timestamp"))


def late_views(spark: SparkSession, path: str, out: str, deg: float = C.GRID_DEG) -> DataFrame:
    """Hours of the written range for which views have arrived that the stream no longer took."""
    whole = _delivered(spark, path, deg)
    done = spark.read.schema(whole.schema).parquet(out)
    last = done.agg(F.max("hour_start")).first()[0]
    seen = whole.where(F.col("hour_start") <= F.lit(last).cast("timestamp")).groupBy("hour_start").agg(F.sum("n_views").alias("arrived"))
    kept = done.groupBy("hour_start").agg(F.sum("n_views").alias("written"))
    return seen.join(kept, "hour_start", "left").fillna(0, ["written"]).withColumn("late", F.col("arrived") - F.col("written")).where("late <> 0")


def _value_columns() -> list[str]:
    return ["n_views"] + [f"{n}_{k}" for n in C.RAINTYPE_LABELS for k in ("sum", "count")]


def stream_hourly_grid(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    watermark: str = "1 day",
    deg: float = C.GRID_DEG,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the job: file source on ``path``, append to Parquet under ``out``.

    A pixel that is delivered again within the watermark counts once. Hours are written when the
    watermark has passed them; ``open_hours`` gives the others, ``late_views`` what came too late.
    """
    source = spark.readStream.schema(SWATH).parquet(path).select(*_NARROW)
    once = source.withWatermark("time", watermark).dropDuplicatesWithinWatermark(PIXEL)
    writer = (
        hourly_grid(once, None, deg)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


# --- merging what comes late --------------------------------------------------


def _arrived(spark: SparkSession, out: str, days: list[str]) -> DataFrame:
    """Pixels of some days that have been taken in so far; only the folders of these days are listed."""
    base = f"{out}/pixels"
    schema = StructType([*SWATH_NARROW, StructField("day", StringType())])
    there = [f for d in days if exists(spark, f := f"{base}/day={d}")]
    return spark.read.schema(schema).option("basePath", base).parquet(*there) if there else spark.createDataFrame([], schema)


def _not_in(new: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct rows of ``new`` that ``have`` lacks; null values are equal."""
    return new.select(*_NARROW, "day").subtract(have.select(*_NARROW, "day"))


def merge_pixels(pixels: DataFrame, out: str, deg: float = C.GRID_DEG) -> None:
    """Take pixels into the hourly grid under ``out``, however late they are and however often they come.

    Pixels that are not there yet are added to ``out/pixels`` by day; the days they touch are computed anew
    from all their pixels and replace those in ``out/hourly``. So the result depends on what has arrived
    only, not on the order or the batches, and a batch that failed half-way can be given again. A pixel that
    comes with other values than before keeps the larger ones (in the order of the columns).
    """
    spark = pixels.sparkSession
    day = F.date_format("time", "yyyy-MM-dd").alias("day")
    new = materialize(pixels.where(S.is_view(ts="time")).select(*_NARROW, day), "arriving")
    days = sorted(r[0] for r in new.select("day").distinct().collect())  # days that a delivery touches
    if days:
        have = _arrived(spark, out, days)
        fresh = materialize(_not_in(new, have), "fresh")
        fresh.write.mode("append").option("compression", "zstd").partitionBy("day").parquet(f"{out}/pixels")
        touched = sorted(r[0] for r in fresh.select("day").distinct().collect())
        if touched:
            rest = [c for c in _NARROW if c not in PIXEL]
            once = _arrived(spark, out, touched).groupBy(*PIXEL, "day").agg(F.max(F.struct(*rest)).alias("x")).select(*PIXEL, "x.*")
            grid = hourly_grid(once, None, deg).withColumn("day", F.date_format("hour_start", "yyyy-MM-dd"))
            (
                grid.hint("rebalance", "day")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd")
                .partitionBy("day")
                .parquet(f"{out}/hourly")
            )
        discard(fresh)
    discard(new)


def merged_grid(spark: SparkSession, out: str, deg: float = C.GRID_DEG) -> DataFrame:
    """The hourly grid that ``merge_pixels`` keeps."""
    schema = hourly_grid(spark.createDataFrame([], SWATH), None, deg).schema
    return spark.read.schema(schema).parquet(f"{out}/hourly").select(*schema.names)


def stream_merged_grid(spark: SparkSession, path: str, out: str, checkpoint: str, deg: float = C.GRID_DEG, available_now: bool = False) -> StreamingQuery:
    """Start the job that merges every delivery under ``path`` into the grid under ``out``.

    No watermark is needed and no hour stays open: what comes late is merged into its day.
    """
    source = spark.readStream.schema(SWATH).parquet(path).select(*_NARROW)
    writer = source.writeStream.foreachBatch(lambda batch, _: merge_pixels(batch, out, deg)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
