"""Reading and writing the Parquet lake.

Landing layout: ``<root>/<table>/mission=/year=/month=/granule=``; one directory per orbit,
so rewriting an orbit replaces exactly its own directory (dynamic partition overwrite) and
never has to carry its neighbours. Compacted layout: ``mission=/year=/month=`` with files
sorted and disjoint in the sort key.

Beside a landing table stands its index, ``<root>/orbit_index/<table>``: the month, rows and
fingerprint of every orbit, in folders of ``BLOCK`` orbits. A write looks up only the blocks of
its own orbits to find those that lie in another month so far, and compaction learns from the
index which months have changed; neither lists nor reads the table. The fingerprint of an orbit
is the sum of its rows' hashes, so that of a month is the sum over its orbits, in any order.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom import schemas
from rainloom.functions.ranking import orbit_start
from rainloom.functions.scalars import int_div
from rainloom.operators.validate import fingerprints, reconcile
from rainloom.session import discard, materialize, shuffles_removed

TABLES = {
    "features": schemas.FEATURES,
    "pixels": schemas.PIXELS,
    "views": schemas.VIEWS,
    "era5": schemas.ENV,
    "grid_views": schemas.GRID_VIEWS,
    "grid_rain": schemas.GRID_RAIN,
    "grid_metrics": schemas.GRID_METRICS,
}
_PARTITIONS = {"year": T.IntegerType(), "month": T.IntegerType(), "granule": T.StringType()}
MONTH = ["mission", "year", "month"]
BLOCK = 1000  # orbits in a folder of the index
SORT_KEYS = {"features": ("feature_id",), "pixels": ("feature_id",), "views": ("lat_bin", "lon_bin")}


def _read_schema(schema: T.StructType, granule: bool) -> T.StructType:
    fields = [f for f in schema.fields if f.name != "mission"]
    fields.append(T.StructField("mission", T.StringType()))
    parts = ["year", "month"] + (["granule"] if granule else [])
    return T.StructType(fields + [T.StructField(p, _PARTITIONS[p]) for p in parts])


def read_table(
    spark: SparkSession, root: str, table: str, mission: str | None = None, months=None, granule: bool = True
) -> DataFrame:
    """Scan a table with its declared schema, pruned to a mission and months of the year.

    A tree that does not exist yet reads as an empty frame with the right columns.
    """
    schema = TABLES[table]
    full = _read_schema(schema, granule)
    try:
        df = spark.read.schema(full).parquet(f"{root}/{table}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        df = spark.createDataFrame([], full)
    if mission is not None:
        df = df.where(F.col("mission") == mission.upper())
    if months is not None:
        df = df.where(F.col("month").isin([int(m) for m in months]))
    order = [f.name for f in schema.fields]
    rest = [c for c in df.columns if c not in order]
    return df.select(*[c for c in order if c in df.columns], *rest)


def read_months(spark: SparkSession, root: str, table: str, mission: str, start, end, granule: bool = True) -> DataFrame:
    """The table as ``read_table`` has it, of the months around [start, end) only.

    Other months are not even listed. An orbit lies in the month of its mean time, so one month more on
    either side holds every row of the window.
    """
    first, last = spark.range(1).select(_month_number(F.lit(start).cast("timestamp")) - 1, _month_number(F.lit(end).cast("timestamp")) + 1).first()
    base = f"{root}/{table}"
    folders = [f"{base}/mission={mission.upper()}/year={k // 12}/month={k % 12 + 1}" for k in range(first, last + 1)]
    there = [f for f in folders if exists(spark, f)]
    schema = _read_schema(TABLES[table], granule)
    df = spark.read.schema(schema).option("basePath", base).parquet(*there) if there else spark.createDataFrame([], schema)
    order = [f.name for f in TABLES[table].fields]
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def _month_number(time: Column) -> Column:
    """Months since the year 0."""
    return F.year(time) * 12 + F.month(time) - 1


def _in_months(df: DataFrame, start: Column, end: Column) -> Column:
    """Of a stored table, the months in which the orbits of [start, end) can lie: a filter on folders."""
    if not {"year", "month"} <= set(df.columns):
        return F.lit(True)
    number = F.col("year") * 12 + F.col("month") - 1
    return (number >= _month_number(start) - 1) & (number <= _month_number(end) + 1)


def scan_features(features: DataFrame, mission: str, start, end, cols: list[str]) -> DataFrame:
    """Chosen columns of one mission in [start, end); of a stored table only the months around it are read."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    keep = (F.col("mission") == mission.upper()) & (F.col("time") >= lo) & (F.col("time") < hi)
    return features.where(_in_months(features, lo, hi)).where(keep).select(*cols)


def features_for_orbits_starting(features: DataFrame, start, end, slack=timedelta(hours=2)) -> DataFrame:
    """All features of the orbits whose first feature lies in [start, end).

    Only a window widened by ``slack`` is read, and of a stored table only the months around that.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    low, high = lo - F.lit(slack), hi + F.lit(slack)
    wide = features.where(_in_months(features, low, high)).where((F.col("time") >= low) & (F.col("time") < high))
    return orbit_start(wide).where((F.col("orbit_start") >= lo) & (F.col("orbit_start") < hi)).drop("orbit_start")


def partition_columns(df: DataFrame) -> DataFrame:
    """Year and month of the mean time of the orbit (null without any time), and the zero-padded orbit."""
    return df.join(orbit_places(df), ["mission", "orbit"], "left")


def orbit_places(df: DataFrame) -> DataFrame:
    """mission, orbit, year, month and granule: one row per orbit."""
    us = F.unix_micros("time")
    sec = F.floor(us / F.lit(1_000_000)).cast("long")
    mean = (
        df.groupBy("mission", "orbit")
        .agg(F.sum(sec).alias("s"), F.count("time").alias("n"))
        .withColumn("mean_time", F.when(F.col("n") > 0, F.timestamp_seconds(int_div("s", F.greatest("n", F.lit(1))))))
    )
    return mean.select("mission", "orbit", F.year("mean_time").alias("year"), F.month("mean_time").alias("month"), F.lpad(F.col("orbit").cast("string"), 6, "0").alias("granule"))


def _upper(df: DataFrame) -> DataFrame:
    return df.withColumn("mission", F.upper("mission"))


def _write_orbits(df: DataFrame, root: str, table: str, time_by: DataFrame | None = None, skip_undated: bool = False) -> DataFrame:
    """Writes whole orbits and returns the place of each; the input is computed once.

    Rows of an orbit without any time fail the job unless they are to be skipped. An orbit that has lain in
    another month so far is deleted there, then the index takes the new places: a write that stops between
    these steps is mended by running it again.
    """
    schema = TABLES[table]
    cols = [f.name for f in schema.fields]
    needed = [c for c in df.columns if c in {*cols, "mission", "orbit", "time"}]
    given = df if getattr(df, "stored_at", None) else materialize(df.select(*needed), f"write-{table}")
    stored = _upper(given.select(*needed))
    own = stored.select("mission", "orbit").distinct()
    places = orbit_places(stored) if time_by is None else own.join(orbit_places(_upper(time_by)), ["mission", "orbit"], "left")
    places = materialize(places.withColumn("granule", F.lpad(F.col("orbit").cast("string"), 6, "0")), f"places-{table}")
    undated = places.where("year IS NULL")
    if not skip_undated and (lost := undated.first()) is not None:
        raise ValueError(f"{table}: no time is known for orbit {lost['mission']} {lost['orbit']}")
    known = exists(df.sparkSession, f"{root}/{table}")
    dated = stored.join(places.where("year IS NOT NULL"), ["mission", "orbit"])
    out = schemas.conform(dated, schema, ("year", "month", "granule")).select(*cols, "year", "month", "granule")
    _replace(out.hint("rebalance", *MONTH, "granule"), [*MONTH, "granule"], f"{root}/{table}")
    marked = out.groupBy("mission", "granule").agg(F.first("year").alias("year"), F.first("month").alias("month"), *fingerprints(cols))
    marked = materialize(marked, f"marked-{table}")
    if known:
        _index(marked, root, table)
    else:  # nothing has been there before
        _put_index(marked.withColumn("block", _block()), root, table)
    if given is not df:
        discard(given)
    return places


def _replace(df: DataFrame, by: list[str], path: str, compression: str = "zstd") -> None:
    """Write the folders that ``df`` has; others stay as they are."""
    with shuffles_removed(df.sparkSession):
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", compression)
            .partitionBy(*by)
            .parquet(path)
        )


# --- the index of a landing table -------------------------------------------

_INDEX = "mission string, granule string, year int, month int, n_rows long, digest decimal(38,0), block int"


def orbit_index(spark: SparkSession, root: str, table: str) -> DataFrame:
    """mission, granule, year, month, n_rows and digest of every orbit of a landing table."""
    path = f"{root}/orbit_index/{table}"
    if not exists(spark, path):
        if not exists(spark, f"{root}/{table}"):
            return spark.createDataFrame([], _INDEX)
        _rebuild_index(spark, root, table)  # a table from before there was an index: read once
    return spark.read.schema(_INDEX).parquet(path)


def _block() -> Column:
    return F.floor(F.col("granule").cast("long") / BLOCK).cast("int")


def _put_index(rows: DataFrame, root: str, table: str) -> None:
    rows = rows.select(*[c.split()[0] for c in _INDEX.split(", ")]).hint("rebalance", "mission", "block")
    _replace(rows, ["mission", "block"], f"{root}/orbit_index/{table}", "snappy")


def _rebuild_index(spark: SparkSession, root: str, table: str) -> None:
    df = read_table(spark, root, table)
    marked = df.groupBy("mission", "granule", "year", "month").agg(*fingerprints([f.name for f in TABLES[table].fields]))
    _put_index(marked.withColumn("block", _block()), root, table)


def _index(new: DataFrame, root: str, table: str) -> None:
    """Delete what earlier writes have left of the orbits of ``new`` in other months, and take their new places down."""
    spark = new.sparkSession
    new = new.withColumn("block", _block())
    path = f"{root}/orbit_index/{table}"
    if not exists(spark, path):
        if not new.isEmpty():
            _rebuild_index(spark, root, table)
        have = orbit_index(spark, root, table)
        # nothing is known about the time before: the table itself shows orbits that lie in two months
        double = have.join(new.select("mission", "granule", F.col("year").alias("_y"), F.col("month").alias("_m")), ["mission", "granule"])
        moved = double.where("year <> _y OR month <> _m")
    else:
        have = orbit_index(spark, root, table)
        touched = new.select("mission", "block").distinct()  # a thousandth of the orbits written
        have = materialize(have.join(F.broadcast(touched), ["mission", "block"], "left_semi"), f"index-{table}")
        moved = have.join(new.select("mission", "granule", F.col("year").alias("_y"), F.col("month").alias("_m")), ["mission", "granule"]).where("year <> _y OR month <> _m")
    # orbits whose mean time has crossed the end of a month: a few of those just written
    for p in moved.select(*MONTH, "granule").collect():
        delete(spark, f"{root}/{table}/" + "/".join(f"{c}={p[c]}" for c in (*MONTH, "granule")))
    kept = have.join(new.select("mission", "granule"), ["mission", "granule"], "left_anti")
    _put_index(materialize(kept.select(*new.columns).unionByName(new), f"index-{table}"), root, table)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _path(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    system, found = _path(spark, path)
    system.delete(found, True)


def write_features(df: DataFrame, root: str) -> None:
    _write_orbits(df, root, "features")


def write_pixels(df: DataFrame, features: DataFrame, root: str) -> None:
    """Pixels go to the month of their orbit's features."""
    _write_orbits(df, root, "pixels", features.select("mission", "orbit", "time"))


def write_views(df: DataFrame, root: str) -> DataFrame:
    """Orbits without a view write nothing; those without any time are skipped and returned as (mission, orbit)."""
    return _write_orbits(df, root, "views", skip_undated=True).where("year IS NULL").select("mission", "orbit")


def write_env(df: DataFrame, root: str, features: DataFrame | None = None) -> None:
    """Environment rows go to the month of their orbit, which the times of ``features`` tell if it is given."""
    _write_orbits(df, root, "era5", None if features is None else features.select("mission", "orbit", "time"))


def write_grid(df: DataFrame, root: str, table: str, months: DataFrame | None = None) -> None:
    """Month grids by (mission, year, month); an empty month still leaves a readable schema.

    ``months`` (mission, year, month) are the ones that were processed: one of them without any row loses
    what an earlier run has stored for it, so that a run can be repeated.
    """
    schema = TABLES[f"grid_{table}"]
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *MONTH)
    if months is not None:
        out = materialize(out, f"write-grid-{table}")
    _write_months(out, f"{root}/grid_{table}")
    if months is not None:
        spark = df.sparkSession
        empty = months.select(*MONTH).distinct().join(out.select(*MONTH).distinct(), MONTH, "left_anti")
        for m in empty.collect():  # bounded by the calendar
            delete(spark, f"{root}/grid_{table}/" + "/".join(f"{c}={m[c]}" for c in MONTH))
        discard(out)


def _write_months(df: DataFrame, path: str) -> None:
    """Replace the months that ``df`` has."""
    _replace(df.hint("rebalance", *MONTH), MONTH, path)


def write_report(report: DataFrame, root: str) -> None:
    """The months that were processed, one row each: a month that is run again replaces its row."""
    _write_months(report, f"{root}/processed_months")


def write_joint(df: DataFrame, path: str) -> None:
    """The lossless sparse joint with mission and month first, with or without hour; other months stay as they are."""
    order = ["mission", "month", "lat_bin", "lon_bin", "hour", "size_class", "echotop_class", "raintype"]
    cols = [c for c in order if c in df.columns]
    out = df.select(*cols, "rain_sum", "raining_count").withColumn("month", F.col("month").cast("short"))
    _replace(out, ["mission", "month"], path)


_COMPACTED = "n_rows long, digest decimal(38,0), mission string, year int, month int"


def compact(
    spark: SparkSession, src: str, dst: str, table: str, order_by: tuple | None = None, overwrite: bool = False, verify: bool = False
) -> DataFrame:
    """Rewrite one table into few sorted files per month under ``dst``; the source stays.

    A month is written if its fingerprint (rows and sum of row hashes, from the index of the source) is
    not the one under which it was compacted last, or with ``overwrite``; a month that the source has no
    more is removed. What was written is read back and compared. ``verify`` also reads the months that
    would be skipped. Returns mission, year, month, source_rows, target_rows and status: ok (written and
    equal), skip, removed, or mismatch.
    """
    cols = [f.name for f in TABLES[table].fields]
    source = orbit_index(spark, src, table).groupBy(*MONTH).agg(F.sum("n_rows").cast("long").alias("n_rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    log = f"{dst}/compacted_months/{table}"
    known = spark.read.schema(_COMPACTED).parquet(log) if exists(spark, log) else spark.createDataFrame([], _COMPACTED)
    if verify or (not exists(spark, log) and exists(spark, f"{dst}/{table}")):
        known = read_table(spark, dst, table, granule=False).groupBy(*MONTH).agg(*fingerprints(cols))
    state = reconcile(source, known)
    todo = F.col("status") != "ok"
    # one row per month of record: bounded by the calendar
    plan = state.withColumn("write", F.col("source_rows").isNotNull() & (F.lit(True) if overwrite else todo)).collect()
    months = [tuple(r[c] for c in MONTH) for r in plan if r["write"]]
    gone = [tuple(r[c] for c in MONTH) for r in plan if r["source_rows"] is None]
    schema = "mission string, year int, month int"
    if months:
        todo_months = F.broadcast(spark.createDataFrame(months, schema))
        order = list(order_by or SORT_KEYS.get(table, ("feature_id",)))
        rows = read_table(spark, src, table).drop("granule").join(todo_months, MONTH, "left_semi")
        _write_sorted(rows, f"{dst}/{table}", order)
        written = read_table(spark, dst, table, granule=False).join(todo_months, MONTH, "left_semi").groupBy(*MONTH).agg(*fingerprints(cols))
        after = materialize(reconcile(source.join(todo_months, MONTH, "left_semi"), written), f"compacted-{table}")
        good = after.where("status = 'ok'").select(F.col("target_rows").alias("n_rows"), F.col("target_digest").alias("digest"), *MONTH)
        _write_months(good, log)
    else:
        after = state.limit(0)
    for m in gone:
        for base in (f"{dst}/{table}", log):
            delete(spark, f"{base}/" + "/".join(f"{c}={v}" for c, v in zip(MONTH, m)))
    columns = [*MONTH, "source_rows", "target_rows", "status"]
    rest = [tuple(r[c] for c in columns[:-1]) + ("removed" if r["source_rows"] is None else "skip",) for r in plan if not r["write"]]
    kinds = schema + ", source_rows long, target_rows long, status string"
    return after.select(*columns).unionByName(spark.createDataFrame(rest, kinds))


def _write_sorted(rows: DataFrame, path: str, order: list[str]) -> None:
    """Months in files that are sorted and disjoint in ``order``."""
    _replace(rows.repartitionByRange(*MONTH, *order).sortWithinPartitions(*MONTH, *order), MONTH, path)


def run_report(granules: DataFrame, features: DataFrame, pixels: DataFrame, views: DataFrame) -> DataFrame:
    """Status of every orbit: ok, empty, skipped_no_radar or failed, with row counts.

    ``granules``: mission, orbit, has_radar. An orbit with radar but neither rows nor views failed.
    """
    keys = ["mission", "orbit"]

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name))

    out = granules.select(*keys, "has_radar")
    for df, name in ((features, "n_features"), (pixels, "n_pixels"), (views, "n_views")):
        out = out.join(count(df, name), keys, "full_outer")
    out = out.fillna(0, ["n_features", "n_pixels", "n_views"])
    status = (
        F.when(~F.coalesce("has_radar", F.lit(True)), F.lit("skipped_no_radar"))
        .when(F.col("n_features") > 0, F.lit("ok"))
        .when(F.col("n_views") > 0, F.lit("empty"))
        .otherwise(F.lit("failed"))
    )
    return out.withColumn("status", status)
