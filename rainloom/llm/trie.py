"""The prefix trie of conversations, in balanced parentheses.

A conversation is rebuilt from turns, and its prefixes are the nodes of a trie. Spark finds the nodes: a
prefix is known by its length and the exclusive or of two hashes of its turns at their places (128 bits),
which are running aggregates, so a conversation of any length is cut into slices. Conversations then go, in
the order of their first turns, to shards. A shard writes the part of the trie that its conversations
touch as parentheses, one pair for a node; the closing one of a pair is found through the least excess of
blocks of parentheses, kept in a tree, and what lies between the two is the subtree: leaves are counted by
the rank of pairs ``()``, savings are differences of running sums. A node counts in the shard of the
smallest conversation that has it and stands without weight in others, so the spines that shards share
are merged by addition.

Only prefixes that several conversations have, and the first one after them, are put in a shard; what
follows is a chain of a single conversation and needs no tree. So a shard's conversation is as long as the
part it shares. Its digest of ending conversations is made of pieces in order, which one task per
node reads one after the other.

Turns stand in the order of ``turn`` (nulls first), then of role and the digest of the text; a null role
or text is empty, very long texts are hashed whole. Repeated rows are turns of their own. Rows without a
conv_id belong to no conversation. An empty table has no trie and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.ranking import row_numbers
from rainloom.llm.common import give_back, materialize

SLICE = 10  # bits of a place inside its slice of a conversation
RANGE = 8  # turns that the order of conversations looks at
PIECE = 1 << 20  # bytes of the list of ending conversations that travel at once
TAIL = 4096  # nodes of a chain that one row gives rise to
NODE = ["depth", "s1", "s2"]


def _check_sum(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, a, b, bytes, len) of the rebuilt conversations, and all conversations (conv_id, len).

    A conversation begins with the first turns of the one whose id is the next lower multiple of five, and
    goes on with its own turns after as many; their number is the check sum of its id modulo nine.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    turns = turns.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"),
                         F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"))
    ranked = row_numbers(turns, ["turn", "role", "digest"], ("conv_id",), "rn")
    turns = materialize(ranked.select("conv_id", (F.col("rn") - 1).alias("p"), F.col("rn_total").alias("n"), "a", "b", "bytes"), "turns")
    convs = turns.where("p = 0").select("conv_id", "n", (_check_sum(F.col("conv_id")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    convs = convs.join(bases, F.col("base") == F.col("_base"), "left").withColumn("m", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialize(convs, "conversations")
    first = turns.where("p < 9").select(F.col("conv_id").alias("_conv"), "p", "a", "b", "bytes")
    copied = convs.join(first, (F.col("base") == F.col("_conv")) & (F.col("p") < F.col("h")))
    own = turns.join(convs, "conv_id").where("p >= h")
    columns = ["a", "b", "bytes", "len"]
    both = copied.select("conv_id", F.col("p").alias("pos"), *columns).unionByName(own.select("conv_id", (F.col("m") + F.col("p") - F.col("h")).alias("pos"), *columns))
    return both, convs.select("conv_id", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, s1, s2, bytes and len for every prefix of a conversation that has turns."""
    slice_of = F.call_function("shiftright", F.col("pos"), F.lit(SLICE))
    placed = turns.select("conv_id", "pos", "bytes", "len", slice_of.alias("slice"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("x"), F.xxhash64(F.lit(2), "pos", "b", "a").alias("y"))
    placed = materialize(placed, "places")
    sums = placed.groupBy("conv_id", "slice").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("conv_id", "slice", F.bit_xor("x").over(before).alias("x0"), F.bit_xor("y").over(before).alias("y0")).where("slice > 0")
    inside = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "slice", (F.col("pos") + 1).alias("depth"), "bytes", "len", F.bit_xor("x").over(inside).alias("x1"), F.bit_xor("y").over(inside).alias("y1"))
    joined = local.join(earlier, ["conv_id", "slice"], "left")
    whole = lambda own, rest: F.col(own).bitwiseXOR(F.coalesce(rest, F.lit(0)))
    return materialize(joined.select("conv_id", "depth", whole("x1", "x0").alias("s1"), whole("y1", "y0").alias("s2"), "bytes", "len"), "prefixes")


class Parentheses:
    """A sequence of parentheses with the least excess of its blocks in a tree.

    ``bits`` has 1 for an opening parenthesis and 0 for a closing one; the excess at a place is the number
    of pairs open after it. ``close`` finds the partner of every opening parenthesis.
    """

    WIDTH = 64

    def __init__(self, bits: np.ndarray):
        self.bits, n = bits, len(bits)
        blocks = 1
        while blocks * self.WIDTH < n:
            blocks *= 2
        excess = np.full(blocks * self.WIDTH, np.iinfo(np.int32).max, np.int32)
        excess[:n] = np.cumsum(bits.astype(np.int32) * 2 - 1)
        self.excess = excess.reshape(blocks, self.WIDTH)
        self.least = np.empty(2 * blocks, np.int32)  # node k has the children 2k and 2k + 1
        self.least[blocks:] = self.excess.min(1)
        while blocks > 1:
            self.least[blocks // 2 : blocks] = np.minimum(self.least[blocks : 2 * blocks : 2], self.least[blocks + 1 : 2 * blocks : 2])
            blocks //= 2

    def close(self, opens: np.ndarray) -> np.ndarray:
        """For each place in ``opens``, the first later one where the excess is lower than there."""
        blocks, width = self.excess.shape
        block, at = opens // width, opens % width
        wanted = self.excess[block, at]
        out = np.full(len(opens), -1)
        for j in range(width - 1):  # partners in the same block
            own = np.flatnonzero(at == j)
            low = self.excess[block[own], j + 1 :] < wanted[own, None]
            hit = low.any(1)
            out[own[hit]] = opens[own[hit]] + 1 + low[hit].argmax(1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            node, goal = block[rest] + blocks, wanted[rest]
            up = np.ones(len(rest), bool)
            while up.any():  # up to the first later sibling that goes low enough
                later = (node & 1 == 0) & (self.least[np.minimum(node + 1, 2 * blocks - 1)] < goal)
                node = np.where(up, np.where(later, node + 1, node // 2), node)
                up &= ~later
            while (inner := node < blocks).any():  # and down to its first block that does
                left = self.least[np.minimum(2 * node, 2 * blocks - 1)] < goal
                node = np.where(inner, 2 * node + ~left, node)
            low = self.excess[node - blocks] < goal[:, None]
            out[rest] = (node - blocks) * width + low.argmax(1)
        return out


def encode(paths: list[list[int]], root: int) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses of the trie of ``paths`` below ``root``, and the node of each opening one."""
    bits, nodes, stack = [1], [root], []
    for path in sorted(paths):
        same = 0
        for a, b in zip(stack, path):
            if a != b:
                break
            same += 1
        bits += [0] * (len(stack) - same) + [1] * (len(path) - same)
        nodes += path[same:]
        stack = path
    return np.array(bits + [0] * (len(stack) + 1), np.uint8), np.array(nodes)


def shard(sizes: np.ndarray, depth, s1, s2, owner, n_convs, n_ends, bytes_, conv) -> dict[str, np.ndarray]:
    """Sums over the subtrees of the nodes of some conversations, as far as these nodes are the shard's own.

    A conversation has ``sizes`` nodes from the first turn down; the other arrays describe them one after
    the other. ``conv`` is the conversation; it owns the nodes whose ``owner`` it is.
    """
    keys = np.stack([depth, s1, s2])
    unique, at, number = np.unique(keys, axis=1, return_index=True, return_inverse=True)
    number, n = number.reshape(-1), unique.shape[1]
    mine = np.bincount(number, owner == conv, n) > 0
    flat, ends = number.tolist(), np.cumsum(sizes).tolist()
    bits, nodes = encode([flat[a:b] for a, b in zip([0, *ends], ends)], n)
    begins = np.cumsum(sizes) - sizes
    above = np.r_[n, number[:-1]]
    above[begins[sizes > 0]] = n
    parent = np.full(n, n)
    parent[number] = above
    tree = Parentheses(bits)
    opens = np.flatnonzero(bits)
    closes = tree.close(opens)
    extra = lambda a, root: np.r_[a[at], root]
    convs, last = extra(n_convs, 0), extra(n_ends, -1)
    own = np.r_[mine, False]
    leaf = own & ((convs == last) | (convs == 1))  # a chain of one conversation has one leaf
    pair = np.zeros(len(bits) + 1, np.int64)  # pairs () before a place
    pair[opens + 1] = (bits[opens + 1] == 0) & leaf[nodes]
    saved = np.zeros(len(bits) + 1, np.int64)
    saved[opens + 1] = np.where(own, (convs - 1) * extra(bytes_, 0), 0)[nodes]
    pair, saved = np.cumsum(pair), np.cumsum(saved)
    back = np.argsort(nodes)  # each node has one opening parenthesis
    opens, closes = opens[back], closes[back]
    owners = extra(owner, 0)
    return {
        "depth": np.r_[unique[0], 0], "s1": np.r_[unique[1], 0], "s2": np.r_[unique[2], 0], "own": own, "conv_id": owners, "n_convs": convs, "n_ends": np.maximum(last, 0),
        "parent": np.r_[owners[parent], 0], "n_children": np.bincount(parent[mine], minlength=n + 1), "n_leaves": pair[closes] - pair[opens], "saved_tokens": saved[closes] - saved[opens],
    }


_SUMS = ["n_children", "n_leaves", "saved_tokens"]
_SHARD = "depth long, s1 long, s2 long, own boolean, conv_id long, n_convs long, n_ends long, parent long, n_children long, n_leaves long, saved_tokens long"


def _shards(batches, schema):
    """All rows of a partition form one shard."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found)
    nodes = rows.column("nodes").combine_chunks()
    sizes = np.diff(nodes.offsets.to_numpy())
    flat = nodes.flatten()
    part = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    conv = np.repeat(rows.column("conv_id").to_numpy(), sizes)
    out = shard(sizes, *(part[c] for c in (*NODE, "owner", "n_convs", "n_ends", "bytes")), conv)
    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    give_back()


def _paths(found: DataFrame) -> DataFrame:
    """conv_id, len, nodes (shared ones from the first turn down, then the first of its own) and alone (the depth of that one)."""
    nodes = found.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"))
    shared = nodes.where("n_convs > 1")
    known = found.join(shared, NODE, "left")
    item = F.struct(*NODE, F.coalesce("owner", "conv_id").alias("owner"), F.coalesce("n_convs", F.lit(1)).alias("n_convs"),
                    F.coalesce("n_ends", (F.col("depth") == F.col("len")).cast("long")).alias("n_ends"), "bytes")
    per = known.groupBy("conv_id").agg(
        F.max("len").alias("len"),
        F.array_sort(F.collect_list(F.when(F.col("n_convs").isNotNull(), item))).alias("nodes"),
        F.min(F.when(F.col("n_convs").isNull(), item)).alias("head"),  # depth comes first
    )
    nodes = F.when(F.col("head").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("head")))
    return materialize(per.select("conv_id", "len", nodes.alias("nodes"), F.col("head.depth").alias("alone")), "paths")


def _ends(ending: DataFrame) -> DataFrame:
    """depth, s1, s2 and ends_sha256 of nodes at which the conversations of ``ending`` (depth, s1, s2, conv_id) end.

    A node's ids are joined in pieces where they stand in order; the pieces of a node pass one task in
    order, one at a time.
    """

    def pieces(batches):
        out, key, size = [], None, 0

        def flush():
            nonlocal out, size
            if out:
                rec = {**{c: [v] for c, v in zip(NODE, key)}, "first": [out[0]], "piece": [",".join(map(str, out))]}
                out, size = [], 0
                yield pa.RecordBatch.from_pydict(rec, schema=cut)

        for batch in batches:
            for *k, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if k != key or size > PIECE:
                    yield from flush()
                    key = k
                out.append(conv)
                size += 8
        yield from flush()

    def hashes(batches):
        key, state, done = None, None, []
        for batch in batches:
            for *k, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece"))):
                if k != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(final.names, r)) for r in done], schema=final)
                done = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(final.names, (*key, state.hexdigest())))], schema=final)

    ids = [(c, pa.int64()) for c in NODE]
    cut, final = pa.schema([*ids, ("first", pa.int64()), ("piece", pa.string())]), pa.schema([*ids, ("ends_sha256", pa.string())])
    longs = ", ".join(f"{c} long" for c in NODE)
    ordered = ending.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    cuts = ordered.mapInArrow(pieces, f"{longs}, first long, piece string")
    return cuts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, f"{longs}, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    turns, convs = rebuilt(conversations)
    paths = _paths(prefixes(turns))
    smallest, count, turnless = convs.agg(F.min("conv_id"), F.count("*"), F.count_if(F.col("len") == 0)).first()
    spark = conversations.sparkSession

    # conversations that own a node, in the order of their first turns
    owning = paths.where(F.exists("nodes", lambda x: x["owner"] == F.col("conv_id"))).select("conv_id", "nodes")
    order = [F.get("nodes", F.lit(k))["s1"] for k in range(RANGE)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_SHARD))
    parts = owning.repartitionByRange(*order, "conv_id").mapInArrow(lambda x: _shards(x, schema), _SHARD)
    parts = materialize(parts, "shards")
    top = spark.createDataFrame([(0, 0, 0, True, smallest, count, turnless, None, 0, 0, 0)] if count else [], _SHARD)
    mine = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    merged = parts.where("n_convs <> 1").unionByName(top).groupBy(*NODE).agg(*[mine(c) for c in ("conv_id", "n_convs", "n_ends", "parent")], *[F.sum(c).alias(c) for c in _SUMS])

    ending = paths.where("alone IS NULL").select(F.element_at("nodes", -1).alias("x"), "conv_id").select(*[f"x.{c}" for c in NODE], "conv_id")
    none = convs.where("len = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    ends = materialize(_ends(materialize(ending.unionByName(none), "ending")), "ends")
    root = F.col("depth") == 0
    nothing, alone = F.sha2(F.lit(""), 256), F.sha2(F.col("conv_id").cast("string"), 256)
    parent = F.when(F.col("depth") > 1, F.col("parent")).when(F.col("depth") == 1, F.lit(smallest)).alias("parent_conv_id")
    shared = merged.join(ends, NODE, "left").select(
        "conv_id", "depth", parent, "n_convs", "n_children", F.when(root & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    # a node of a single conversation: the first such of each comes from its shard, those below it form a chain
    one = parts.where("n_convs = 1")
    heads = one.select("conv_id", "depth", parent, "n_convs", (1 - F.col("n_ends")).alias("n_children"), "n_leaves", "saved_tokens", F.when(F.col("n_ends") == 1, alone).otherwise(nothing).alias("ends_sha256"))
    below = paths.where(F.col("alone") < F.col("len")).select("conv_id", "len", F.explode(F.sequence(F.col("alone") + 1, F.col("len"), F.lit(TAIL))).alias("start"))
    below = below.select("conv_id", "len", F.explode(F.sequence("start", F.least(F.col("start") + (TAIL - 1), F.col("len")))).alias("depth"))
    last = F.col("depth") == F.col("len")
    chains = below.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
                          F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, alone).otherwise(nothing).alias("ends_sha256"))
    return shared.unionByName(heads).unionByName(chains)
