"""Contiguous rain areas: connected components on the scan x ray lattice.

Raining pixels are first compressed to runs along each scan. The runs of a tile of scans
are joined where they stand, in one pass over a bounded array. Only what touches across the
border of two tiles takes part in the component search, which alternates two contractions of
the graph of the tiles' components (every node points its larger neighbours, then its smaller
ones, at the smallest node it sees) until nothing changes. Its steps are joins and
min-aggregates, so a component of any size is spread over the cluster, and the rounds grow
with the tiles it crosses, not with its pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.scalars import int_div, is_number, mission_code
from rainloom.operators.geometry import TILE_SCANS
from rainloom.session import discard, growing, materialize

ORBIT = ["mission", "orbit"]
# A run is named by its orbit, scan and first ray; the order of names within an orbit is
# the row-major order of the pixels.
_SCAN_SPAN = 1 << 20
_RAY_SPAN = 1 << 12


def dbz_floor(floors: dict[str, float] | None = None) -> Column:
    floors = C.DBZ_FLOOR if floors is None else floors
    out = F.when(F.lit(False), F.lit(0.0))
    for mission, floor in floors.items():
        out = out.when(F.upper(F.col("mission")) == mission, F.lit(float(floor)))
    return out.otherwise(F.lit(C.DBZ_FLOOR_DEFAULT))


def rain_mask(swath: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Pixels at or above the reflectivity floor of their mission."""
    dbz = F.col("near_sfc_dbz")
    return swath.where(is_number(dbz) & (dbz.cast("double") >= dbz_floor(floors)))


def scan_runs(mask: DataFrame) -> DataFrame:
    """Unbroken stretches of raining rays: run, mission, orbit, scan, r0, r1.

    An unknown mission, or a scan or ray beyond what the key of a run has room for, fails the job.
    """
    w = Window.partitionBy(*ORBIT, "scan").orderBy("ray")
    runs = (
        mask.select(*ORBIT, "scan", "ray")
        .withColumn("island", F.col("ray") - F.row_number().over(w))
        .groupBy(*ORBIT, "scan", "island")
        .agg(F.min("ray").alias("r0"), F.max("ray").alias("r1"))
        .drop("island")
    )
    code = mission_code("mission")
    in_range = F.col("scan").between(0, _SCAN_SPAN - 1) & (F.col("r0") >= 0) & (F.col("r1") < _RAY_SPAN)
    which = F.concat_ws(" ", F.lit("no run key for"), "mission", *[F.col(c).cast("string") for c in ("orbit", "scan", "r1")])
    key = ((code.cast("long") * C.ID_ORBIT_MULT + F.col("orbit")) * _SCAN_SPAN + F.col("scan")) * _RAY_SPAN + F.col("r0")
    return runs.withColumn("run", F.when(code.isNotNull() & in_range, key).otherwise(F.raise_error(which).cast("long")))


def run_edges(runs: DataFrame, connectivity: int = 2) -> DataFrame:
    """Touching runs of consecutive scans as (u, v), u < v.

    The join key is one scan of one orbit, which holds at most half as many runs as rays.
    """
    reach = 1 if connectivity == 2 else 0
    upper = runs.select(*ORBIT, "scan", F.col("run").alias("u"), F.col("r0").alias("a0"), F.col("r1").alias("a1"))
    lower = runs.select(
        *ORBIT, (F.col("scan") - 1).alias("scan"), F.col("run").alias("v"), F.col("r0").alias("b0"), F.col("r1").alias("b1")
    )
    touching = (F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)
    return upper.join(growing(lower), [*ORBIT, "scan"]).where(touching).select("u", "v", "scan")


def touching_runs(scan: np.ndarray, r0: np.ndarray, r1: np.ndarray, tile: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of consecutive scans of a tile that touch; runs are sorted by tile, scan and ray."""
    line = tile * (1 << 24) + scan
    begin, end = line * _RAY_SPAN + r0, line * _RAY_SPAN + r1
    below = (line + 1) * _RAY_SPAN
    low = np.maximum(np.searchsorted(end, below + r0 - reach), np.searchsorted(line, line + 1))
    high = np.minimum(np.searchsorted(begin, below + r1 + reach, "right"), np.searchsorted(line, line + 1, "right"))
    n = np.maximum(high - low, 0)
    first = np.repeat(np.arange(len(scan)), n)
    return first, np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def least_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component: labels go along the edges and jump along themselves."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        after = root.copy()
        for end in (root[u], root[v]):
            np.minimum.at(after, end, low)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        root = after
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def tile_roots(runs: DataFrame, connectivity: int = 2, scans: int = TILE_SCANS) -> DataFrame:
    """``runs`` with ``low``, the first run of their component inside their tile of scans.

    A tile is one array with at most half as many runs per scan as there are rays.
    """
    reach = 1 if connectivity == 2 else 0
    tiles = runs.groupBy(*ORBIT, int_div("scan", scans).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("run", F.col("scan").cast("long").alias("scan"), F.col("r0").cast("long").alias("r0"), F.col("r1").cast("long").alias("r1")))).alias("x"))

    def join(batches):
        for batch in batches:
            lists = batch.column("x")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            run, scan, r0, r1 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("run", "scan", "r0", "r1"))
            tile = np.repeat(np.arange(len(sizes)), sizes)
            low = least_reachable(len(run), *touching_runs(scan, r0, r1, tile, reach))
            own = [batch.column(c).take(pa.array(tile)) for c in ORBIT]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (run, scan, r0, r1, run[low]))], names=[*ORBIT, "run", "scan", "r0", "r1", "low"])

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    found = tiles.select(*ORBIT, "x").mapInArrow(join, ", ".join(f"{c} {kinds[c]}" for c in ORBIT) + ", run long, scan long, r0 long, r1 long, low long")
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (*ORBIT, "scan", "r0", "r1", "run")], "low")


def border_edges(tiled: DataFrame, connectivity: int = 2, scans: int = TILE_SCANS) -> DataFrame:
    """Components of neighbouring tiles that touch across the border, as (u, v), u < v."""
    last, first = F.pmod(F.col("scan"), F.lit(scans)) == scans - 1, F.pmod(F.col("scan"), F.lit(scans)) == 0
    rows = tiled.where(last | first)
    return run_edges(rows.withColumns({"run": F.col("low")}), connectivity).where(F.pmod(F.col("scan"), F.lit(scans)) == scans - 1).select("u", "v").distinct()


def _point_larger(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return (
        both.where("v > u").join(growing(low), "u").select(F.col("low").alias("u"), "v").where("u < v").distinct()
    )


def _point_smaller(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("v").agg(F.min("u").alias("low"))
    return (
        edges.join(growing(low), "v")
        .select("low", F.explode(F.array("u", "v")).alias("v"))
        .where("low < v")
        .select(F.col("low").alias("u"), "v")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Only stars left: no node is both centre and member, none belongs to two centres."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(0).alias("tail")), F.struct(F.col("v").alias("n"), F.lit(1).alias("tail")))).alias("e"))
    broken = (
        ends.groupBy("e.n")
        .agg(F.sum("e.tail").alias("tails"), F.count_if(F.col("e.tail") == 0).alias("heads"))
        .where("tails > 1 OR (tails > 0 AND heads > 0)")
    )
    return broken.isEmpty()


def components(edges: DataFrame, max_rounds: int = 40, steps: int = 1) -> DataFrame:
    """(node, root) for every node with an edge that is not itself the root.

    Lineage is cut once per round of ``steps`` contractions, and the table of the round before is
    deleted. The rounds grow with the logarithm of the longest chain; more than ``max_rounds`` raise.
    """
    stored = None
    for _ in range(max_rounds):
        for _ in range(steps):
            edges = _point_smaller(_point_larger(edges))
        before, edges = stored, materialize(edges, "edges")
        stored = edges
        if before is not None:
            discard(before)
        if _settled(edges):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError("component search did not settle")


def label_features(
    swath: DataFrame,
    floors: dict[str, float] | None = None,
    min_area: float = C.MIN_AREA_KM2,
    min_pixels: int = C.MIN_PIXELS,
    connectivity: int = 2,
    areas: DataFrame | None = None,
) -> DataFrame:
    """Member pixels with ``local_label``, numbered per orbit by first pixel in row-major order.

    Small components are dropped after numbering. A component with a pixel of unknown area
    has no known area and is dropped as well. ``pixel_area`` comes from ``areas`` (keyed by
    pixel) or else from the swath.
    """
    runs = materialize(tile_roots(scan_runs(rain_mask(swath, floors)), connectivity, TILE_SCANS), "runs")
    edges = materialize(border_edges(runs, connectivity, TILE_SCANS), "borders")
    if edges.isEmpty():
        runs = runs.withColumn("root", F.col("low"))
    else:
        member = components(edges).withColumnRenamed("node", "low")
        runs = runs.join(growing(member), "low", "left").withColumn("root", F.coalesce("root", "low"))
    # The feature key leaves room for fewer than 100,000 labels per orbit, which bounds this window.
    numbered = (
        runs.where("root = run")
        .select(*ORBIT, "root")
        .withColumn("local_label", F.row_number().over(Window.partitionBy(*ORBIT).orderBy("root")))
        .select("root", "local_label")
    )
    pixels = (
        runs.join(growing(numbered), "root")
        .select(*ORBIT, "scan", F.explode(F.sequence("r0", "r1")).alias("ray"), "local_label")
    )
    areas = (swath if areas is None else areas).select(
        *ORBIT, "scan", "ray", F.col("pixel_area").cast("double").alias("area")
    )
    sized = materialize(pixels.join(growing(areas), [*ORBIT, "scan", "ray"], "left"), "labels")
    kept = (
        sized.groupBy(*ORBIT, "local_label")
        .agg(F.count("*").alias("npixels"), F.sum("area").alias("area_km2"), F.count("area").alias("known"))
        .where((F.col("known") == F.col("npixels")) & (F.col("npixels") >= min_pixels) & (F.col("area_km2") >= min_area))
    )
    return sized.drop("area").join(growing(kept.select(*ORBIT, "local_label")), [*ORBIT, "local_label"], "left_semi")


def swath_extent(swath: DataFrame) -> DataFrame:
    """First and last scan and ray of every orbit."""
    return swath.groupBy(*ORBIT).agg(
        F.min("scan").alias("scan_first"),
        F.max("scan").alias("scan_last"),
        F.min("ray").alias("ray_first"),
        F.max("ray").alias("ray_last"),
    )


def touches_edge(labels: DataFrame, swath: DataFrame) -> DataFrame:
    """Per feature: does it reach the first or last scan or ray of its orbit?"""
    box = labels.groupBy(*ORBIT, "local_label").agg(
        F.min("scan").alias("s0"), F.max("scan").alias("s1"), F.min("ray").alias("q0"), F.max("ray").alias("q1")
    )
    at_edge = (
        (F.col("s0") == F.col("scan_first"))
        | (F.col("s1") == F.col("scan_last"))
        | (F.col("q0") == F.col("ray_first"))
        | (F.col("q1") == F.col("ray_last"))
    )
    return box.join(growing(swath_extent(swath)), ORBIT).select(*ORBIT, "local_label", at_edge.alias("edge"))
