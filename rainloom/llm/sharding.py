"""Shards by best-fit-decreasing bin packing of indivisible groups (equal texts).

Items in falling size enter the bin with the tightest room that holds them, found in a balanced tree of rooms.

With a fixed capacity there are as many bins as that takes. Groups of one size are alike, and so are bins with
one room, so the driver packs counts: one entry for each size that occurs, which stands for all its groups.
The groups then find their bins by their rank among those of their size.

With a fixed number of shards the capacity is the least one found at which they are enough. Groups above a
grain, a fixed part of a shard, number at most total / grain and are packed one by one; all smaller ones are
gathered by hash into a fixed number of bundles, which are packed as groups too. So what the driver packs is
bounded whatever the number of documents.

A null text counts as an empty one; long texts are hashed whole. A group larger than a fair share stays whole, alone in its shard
unless others fit, and the other shards share the rest. Repeated rows are separate documents. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.functions.ranking import row_numbers
from rainloom.llm.common import materialize

SHARDS = 16
GRAINS = 512  # grains of a shard
BUNDLES = 8192


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _height(t):
    return t.height if t else 0


def _balanced(t):
    t.height = 1 + max(_height(t.left), _height(t.right))
    lean = _height(t.left) - _height(t.right)
    if lean > 1:
        if _height(t.left.left) < _height(t.left.right):
            t.left = _turned(t.left, "right", "left")
        return _turned(t, "left", "right")
    if lean < -1:
        if _height(t.right.right) < _height(t.right.left):
            t.right = _turned(t.right, "left", "right")
        return _turned(t, "right", "left")
    return t


def _turned(t, up, down):
    top = getattr(t, up)
    setattr(t, up, getattr(top, down))
    setattr(top, down, t)
    for x in (t, top):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return top


class Rooms:
    """Height-balanced search tree of (room, bin)."""

    def __init__(self):
        self.root = None

    def add(self, key):
        def down(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = down(t.left)
            else:
                t.right = down(t.right)
            return _balanced(t)

        self.root = down(self.root)

    def drop(self, key):
        def down(t, key):
            if key < t.key:
                t.left = down(t.left, key)
            elif key > t.key:
                t.right = down(t.right, key)
            elif t.left is None or t.right is None:
                return t.left or t.right
            else:
                least = t.right
                while least.left:
                    least = least.left
                t.key = least.key
                t.right = down(t.right, least.key)
            return _balanced(t)

        self.root = down(self.root, key)

    def tightest(self, size: int):
        """The least (room, bin) with room for ``size``, or None."""
        t, found = self.root, None
        while t:
            if t.key[0] >= size:
                found, t = t.key, t.left
            else:
                t = t.right
        return found


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size (in falling order, none above ``capacity``); None once more than ``most`` bins are needed."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.tightest(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        else:
            rooms.drop(found)
        rooms.add((found[0] - size, found[1]))
        out.append(found[1])
    return out


def spread(sizes: list[int], bins: int) -> list[int]:
    """Bins by ``best_fit`` at about the least capacity at which ``bins`` are enough.

    Sizes above a fair share of what is left get a bin of their own first.
    """
    out, left, total = {}, list(range(len(sizes))), sum(sizes)
    while left and len(out) < bins - 1 and sizes[left[0]] * (bins - len(out)) > total:
        total -= sizes[left[0]]
        out[left.pop(0)] = len(out)
    own, rest = len(out), [sizes[i] for i in left]
    if rest:
        low = max(-(-total // (bins - own)), rest[0])
        step, found = 0, best_fit(rest, low, bins - own)
        good = bad = low
        while found is None:
            step = max(1, low // 8192) if not step else step * 2
            bad, good = good, low + step
            found = best_fit(rest, good, bins - own)
        while good - bad > max(1, low // 8192):
            mid = (good + bad) // 2
            tried = best_fit(rest, mid, bins - own)
            good, bad, found = (mid, bad, tried) if tried is not None else (good, mid, found)
        out |= {i: own + b for i, b in zip(left, found)}
    return [out[i] for i in range(len(sizes))]


def fill_by_count(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit in falling size over counts of sizes: (size, low, high, first bin, number in a bin).

    Items of one size go into a bin as long as they fit, since its room is the tightest from then on; bins of
    one room are used one after the other. So whole ranges of items and bins are placed at a time: those with
    ranks from ``low`` to ``high``, a fixed number in each bin from ``first`` on.
    """
    rooms, many, bins, out = Rooms(), {}, 0, []
    for size in sorted(histogram, reverse=True):
        at, count = 0, histogram[size]
        while at < count:
            found = rooms.tightest(size)
            if found is None:
                room, first, there = capacity, bins, count  # as many new ones as are needed
            else:
                (room, first), there = found, many[found]
            each = room // size
            used = min(there, max(1, (count - at) // each))
            each = min(each, count - at)
            if found is None:
                bins += used
            else:
                rooms.drop(found)
                del many[found]
                if used < there:
                    rooms.add((room, first + used))
                    many[room, first + used] = there - used
            rest = (room - each * size, first)
            rooms.add(rest)
            many[rest] = used
            out.append((size, at, at + used * each, first, each))
            at += used * each
    return out


def _fixed(keyed: DataFrame, capacity: int) -> DataFrame:
    """key and shard of every group, in shards of a fixed capacity."""
    groups = materialize(keyed.groupBy("key").agg(F.sum("size").alias("whole")), "groups")
    histogram = {r["whole"]: r["n"] for r in groups.groupBy("whole").agg(F.count("*").alias("n")).collect()}  # sizes that occur
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a group of {max(histogram)} bytes is larger than a shard of {capacity}")
    plan = keyed.sparkSession.createDataFrame(fill_by_count(histogram, capacity), "whole long, low long, high long, first long, each long")
    ranked = row_numbers(groups, ["key"], ("whole",), "_r").withColumn("_r", F.col("_r") - 1)
    placed = ranked.join(materialize(plan, "plan"), "whole").where((F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high")))
    return placed.select("key", (F.col("first") + F.floor((F.col("_r") - F.col("low")) / F.col("each"))).cast("int").alias("shard"))


def _items(keyed: DataFrame, grain: int) -> tuple[list, list]:
    """(key, size) of the groups above ``grain`` and (bundle, size) of the rest."""
    groups = keyed.groupBy("key").agg(F.sum("size").alias("size"))
    large = groups.where(F.col("size") > grain)
    small = groups.where(F.col("size") <= grain).groupBy(_bundle().alias("bundle")).agg(F.sum("size").alias("size"))
    return large.collect(), small.collect()


def _bundle():
    return F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("int")


def _even(keyed: DataFrame, shards: int) -> DataFrame:
    """``keyed`` with the shard of each row, in a fixed number of shards."""
    spark = keyed.sparkSession
    total = keyed.agg(F.sum("size")).first()[0] or 0
    large, small = _items(keyed, max(1, -(-total // shards) // GRAINS))
    items = sorted([(r["size"], 0, bytes(r["key"])) for r in large] + [(r["size"], 1, r["bundle"]) for r in small], key=lambda x: (-x[0], x[1], x[2]))
    bins = spread([i[0] for i in items], shards)
    of_key = spark.createDataFrame([(bytearray(k), b) for (_, kind, k), b in zip(items, bins) if not kind], "key binary, own int")
    of_bundle = spark.createDataFrame([(k, b) for (_, kind, k), b in zip(items, bins) if kind], "bundle int, shared int")
    # at most shards * GRAINS keys and BUNDLES bundles
    placed = keyed.withColumn("bundle", _bundle()).join(F.broadcast(of_key), "key", "left").join(F.broadcast(of_bundle), "bundle", "left")
    return placed.withColumn("shard", F.coalesce("own", "shared"))


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its shard and its place there.

    With ``capacity`` the shards have this fixed size, as few as best fit needs; otherwise there are
    ``shards`` of near equal size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    data = text.cast("binary")
    keyed = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("key")),
        "sizes",
    )
    if capacity is None:
        placed = _even(keyed, shards)
    else:
        placed = keyed.join(_fixed(keyed, capacity), "key")
    placed = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "key")
    ranked = row_numbers(placed, ["doc_id", "key"], ("shard",), "_r")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
