"""Unions, pooled members, missing months, comparisons of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import constants as C


def union_by_name(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


concat = union_by_name


def combined_member(totals: DataFrame, values: list[str], keys=("lat_bin", "lon_bin"), band=None, deg=C.GRID_DEG) -> DataFrame:
    """Each mission's totals and their sum as member COMBINED, in one aggregation."""
    from rainloom.operators.gridding import clip_band

    if band is not None:
        totals = clip_band(totals, band=band, deg=deg)
    members = F.explode(F.array(F.col("mission"), F.lit("COMBINED")))
    return (
        totals.withColumn("member", members)
        .groupBy("member", *keys)
        .agg(*[F.sum(v).alias(v) for v in values])
    )


def missing_months(inventory: DataFrame, by: str = "mission") -> DataFrame:
    """Months absent between the first and the last one present (columns year, month)."""
    first_day = F.make_date("year", "month", F.lit(1))
    span = inventory.groupBy(by).agg(F.min(first_day).alias("lo"), F.max(first_day).alias("hi"))
    full = span.select(by, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("d"))
    full = full.select(by, F.year("d").alias("year"), F.month("d").alias("month"))
    return full.join(inventory.select(by, "year", "month").distinct(), [by, "year", "month"], "left_anti")


def month_coverage(inventory: DataFrame, present: Column, by: str = "mission") -> DataFrame:
    """Every month between the first and the last one: its rows, those that are ``present``, and whether none is."""
    counts = inventory.groupBy(by, "year", "month").agg(F.count("*").alias("n"), F.count_if(present).alias("n_present"))
    absent = missing_months(counts, by).withColumns({"n": F.lit(0).cast("long"), "n_present": F.lit(0).cast("long")})
    return counts.unionByName(absent).withColumn("missing", F.col("n_present") == 0)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one input but not the other, with multiplicity; empty when equal."""
    b = b.select(*a.columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )


def shared_ids(df: DataFrame, key: str = "feature_id", by: str = "mission") -> DataFrame:
    """Keys that occur under more than one mission; empty when the id sets are disjoint."""
    return df.groupBy(key).agg(F.count_distinct(by).alias("n_groups")).where("n_groups > 1")
