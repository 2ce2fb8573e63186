"""Connected components of a table of edges, by rounds of joins.

Repeated edges and loops count once or not at all; edges with a null end are none. A table without edges has
no components and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import discard, materialize


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component): the least id that each end of an edge (a, b) can reach.

    Each round replaces every edge by one from either end to the least of the neighbours: first from the
    larger neighbours, then from the smaller ones. The number of edges never grows, and the rounds are
    about the logarithm of the longest chain. Every round is a table in the shared folder that is deleted
    when the next one is there.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-edges")
    shape = _shape(now)
    while True:
        # each minimum is stored before it is joined, so that both sides of the join come from a scan:
        # only then can Spark split a node with very many edges
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-low")
        # large star: neighbours above u point to the least neighbour of u (or u itself)
        large = materialize(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b"), f"{label}-large")
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), f"{label}-least")
        # small star: u and its neighbours below point to the least of them
        spread = large.join(least, "b")
        small = spread.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(spread.select(F.col("m").alias("a"), "b"))
        after = materialize(small.where("a < b").distinct(), f"{label}-edges")
        for done in (now, low, large, least):
            discard(done)
        before, shape = shape, _shape(after)
        if shape == before:
            return after.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component").unionByName(
                after.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
            )
        now = after


def _shape(edges: DataFrame) -> tuple:
    """Number of distinct edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
