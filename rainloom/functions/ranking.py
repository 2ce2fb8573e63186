"""Ranks, shares, top rows and exact quantiles that hold up on unevenly sized groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.scalars import int_div
from rainloom.session import materialize


def orbit_start(df: DataFrame, by: tuple = ("mission", "orbit")) -> DataFrame:
    """Add the earliest time of each orbit to its rows.

    An aggregate joined back rather than a window, so one long orbit is not one task.
    """
    first = df.groupBy(*by).agg(F.min("time").alias("orbit_start"))
    return df.join(first, list(by))


def share_of_total(df: DataFrame, value: str, by: tuple = (), name: str = "share") -> DataFrame:
    """Percent of the total of ``value`` over already grouped rows."""
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return df.withColumn(name, F.lit(100.0) * F.try_divide(F.col(value), total))


def cumulative_share(df: DataFrame, order: str, value: str, by: tuple = (), name: str = "cumulative") -> DataFrame:
    """Running percent of ``value`` over already grouped (binned) rows."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    running = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.lit(100.0) * F.try_divide(F.sum(value).over(running), F.sum(value).over(part)))


def top_k(
    df: DataFrame, col: str, k: int = 10, largest: bool = True, by: tuple = (), tie: tuple = ("feature_id",)
) -> DataFrame:
    """The k rows with the largest (smallest) value, nulls and NaN left out.

    Per group the row-number filter is applied before the shuffle as well as after it.
    """
    ranked = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    order = [F.col(col).desc() if largest else F.col(col).asc(), *tie]
    if not by:
        return ranked.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax_by(df: DataFrame, value: str, order: str, by: tuple) -> DataFrame:
    """``order`` of the largest ``value`` per group; the first one on a tie."""
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(*by, (-F.col("b.o")).alias(order), F.col("b.v").alias(value))


def normalise_to_mean(df: DataFrame, value: str, by: tuple, name: str = "normalised") -> DataFrame:
    """Divide by the group mean, on an already aggregated series."""
    return df.withColumn(name, F.try_divide(F.col(value), F.avg(value).over(Window.partitionBy(*by))))


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number rows in their current order; carry it along and sort only for display.

    Ids grow along the rows of a partition and from partition to partition.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def input_ordinal(scan: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a file scan by file (in the order of the paths) and row, from 0.

    Needs a frame that comes straight from ``spark.read``: the place of a row is what its file says, however
    the files are split over tasks. Rows stay where they are; only a count per file is moved.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = scan.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")).groupBy("_path").agg((F.max("_row") + 1).alias("_n"))
    # one row per file
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(starts, F.col("_file") == F.col("_path")).withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_path", "_start")


def sort_within(df: DataFrame, *cols: str) -> DataFrame:
    return df.sortWithinPartitions(*cols)


def min_count(df: DataFrame, n: int, col: str = "n") -> DataFrame:
    return df.where(F.col(col) >= n)


# --- global ranks ---------------------------------------------------------


def row_numbers(df: DataFrame, order: list[str], by: tuple = (), name: str = "rn") -> DataFrame:
    """Row number of every row within its group in the order of ``order``, at any group size.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks;
    each row is numbered inside its own slice, and the counts of the earlier slices are
    added. Slices are written first, so their borders cannot move between the two steps.
    ``order`` should end in a unique column.
    """
    keys = list(by)
    sliced = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "ranked"
    )
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    # at most one row per group and slice
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy(*(keys or [F.lit(1)]))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        f"{name}_total", F.sum("_n").over(totals)
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.withColumn("_local", F.row_number().over(inside))
    conds = None
    for k in [*keys, "_slice"]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
        conds = c if conds is None else conds & c
    joined = local.alias("l").join(counts.alias("c"), conds)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("c._before")).alias(name),
        F.col(f"c.{name}_total"),
    )


def quantile_group(df: DataFrame, col: str, n: int, tie: str, by: tuple = (), name: str = "quantile") -> DataFrame:
    """``ntile(n)`` over the whole group without sorting it in one task."""
    ranked = row_numbers(df.where(F.col(col).isNotNull()), [col, tie], by, "_rn")
    total, rn = F.col("_rn_total"), F.col("_rn")
    small = int_div(total, n)
    extra = F.pmod(total, F.lit(n))
    in_large = extra * (small + 1)
    tile = F.when(rn <= in_large, int_div(rn - 1, small + 1) + 1).otherwise(
        extra + int_div(rn - 1 - in_large, F.greatest(small, F.lit(1))) + 1
    )
    return ranked.withColumn(name, tile.cast("int")).drop("_rn", "_rn_total")


def exact_percentiles(
    df: DataFrame, by: tuple, value: str, probs: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact percentiles with linear interpolation per group: one column per entry of ``probs``.

    ``bounded=True`` is for groups known to be small (the built-in aggregate keeps a whole
    group in one buffer). Otherwise values are counted first, ranked by ``row_numbers`` and
    only the few rows around each wanted rank are kept.
    """
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if bounded:
        p = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(x)) for x in probs.values()]))
        out = present.groupBy(*by).agg(p.alias("_p"), F.count("*").alias("n"))
        return out.select(*by, *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(probs)], "n")
    distinct = (
        present.select(*by, F.col(value).cast("double").alias("_v"))
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_c"))
    )
    ranked = _cumulative_counts(distinct, by)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()]
    )
    spot = F.col("w.p") * (F.col("_total") - 1)
    low, high = F.floor(spot) + 1, F.ceil(spot) + 1
    first, last = F.col("_upto") - F.col("_c") + 1, F.col("_upto")
    near = (
        ranked.withColumn("w", F.explode(wanted))
        .where((first <= high) & (last >= low))
        .select(
            *by,
            F.col("w.name").alias("_name"),
            F.col("_total"),
            F.when((first <= low) & (last >= low), F.col("_v")).alias("_lo"),
            F.when((first <= high) & (last >= high), F.col("_v")).alias("_hi"),
            (spot - F.floor(spot)).alias("_f"),
        )
    )
    point = near.groupBy(*by, "_name").agg(
        F.max("_lo").alias("lo"), F.max("_hi").alias("hi"), F.max("_f").alias("f"), F.max("_total").alias("n")
    )
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")
    return point.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == c, value_at)).alias(c) for c in probs], F.max("n").alias("n")
    )


def running_sums(df: DataFrame, by: tuple, order: str, cols: list[str]) -> DataFrame:
    """Sums of ``cols`` up to each row of its group (``<col>_upto``) and over all of it (``<col>_total``).

    ``order`` is unique in a group. Sliced like ``row_numbers``, for groups of any size. ``last`` is 1 on
    the last row of a group and 0 elsewhere.
    """
    keys = list(by)
    sliced = materialize(df.repartitionByRange(*keys, order).withColumn("_slice", F.spark_partition_id()), "summed")
    part = Window.partitionBy(*(keys or [F.lit(1)]))
    before = part.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "_slice").agg(F.max(order).alias("_top"), *[F.sum(c).alias(f"_{c}") for c in cols])
    slices = slices.withColumn("_end", F.max("_top").over(part))
    for c in cols:
        slices = slices.withColumns({f"_{c}_before": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)), f"{c}_total": F.sum(f"_{c}").over(part)})
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced
    for c in cols:
        local = local.withColumn(f"_{c}_local", F.sum(c).over(inside))
    cond = None
    for k in [*keys, "_slice"]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}"))
        cond = c if cond is None else cond & c
    joined = local.alias("l").join(slices.alias("s"), cond)
    sums = [(F.col(f"l._{c}_local") + F.col(f"s._{c}_before")).alias(f"{c}_upto") for c in cols]
    last = (F.col(f"l.{order}") == F.col("s._end")).cast("int").alias("last")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *sums, *[F.col(f"s.{c}_total") for c in cols], last)


def _cumulative_counts(distinct: DataFrame, by: tuple) -> DataFrame:
    """Running count per group over its distinct values, sliced like ``row_numbers``."""
    keys = list(by)
    sliced = materialize(
        distinct.repartitionByRange(*keys, "_v").withColumn("_slice", F.spark_partition_id()), "counted"
    )
    part = keys or [F.lit(1)]
    before = Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*part)))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum("_c").over(inside))
    cond = None
    for k in [*keys, "_slice"]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}"))
        cond = c if cond is None else cond & c
    return local.alias("l").join(slices.alias("s"), cond).select(
        *[F.col(f"l.{k}") for k in keys],
        "l._v",
        "l._c",
        (F.col("l._local") + F.col("s._before")).alias("_upto"),
        "s._total",
    )


def median(df: DataFrame, by: tuple, value: str, bounded: bool = False) -> DataFrame:
    return exact_percentiles(df, by, value, {"median": 0.5}, bounded)


def bin_floor(col, width: float) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(float(width))).cast("int")
