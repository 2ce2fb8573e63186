"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: HotSpot never compiles a method above 8,000 bytes; a wide projection in one method runs interpreted, eight times as long.
HUGE_METHODS = "spark.sql.codegen.hugeMethodLimit"

#: Shuffle files of a query are removed when it ends; otherwise they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None


def build_session(app: str = "rainloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        HUGE_METHODS: "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session whose executors are threads of the driver (``local``, ``local[n]``) may do
    without that setting; it gets a temporary folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_root


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes inside leave no shuffle files behind: what they have written is read from its table from then on."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with data that outlives executors; the Parquet sizes then let
    adaptive execution choose joins from real figures.
    """
    path = f"{shared_folder(df.sparkSession)}/rainloom/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def growing(df: DataFrame) -> DataFrame:
    """``df`` for a join in which both sides grow with the input: it is shuffled, never broadcast.

    The planner knows a Parquet table by its size on disk. Lattice columns (orbit, scan, ray) take
    up to a hundred times that as rows, and the driver would have to hold all of them.
    """
    return df.hint("merge")


def discard(stored: DataFrame) -> None:
    """Delete the table behind a materialised frame that nothing will read again."""
    path = getattr(stored, "stored_at", None)
    if path is not None:
        jvm, conf = stored.sparkSession._jvm, stored.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
