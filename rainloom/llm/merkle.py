"""A Merkle manifest of a table of documents: one tree per language, and one over their roots.

A level of a tree is text: the hex digests of its nodes, one after another. Every aligned block of leaves
keeps each of its levels as one such string; a parent is the hash of a fixed-width substring of the level
below, and the siblings of a node are the substrings beside it. The roots of the blocks are the leaves of
the next round, until each tree has one block. Neither a tree nor a language is ever in one task; texts
are hashed where they are read and never travel.

Leaves stand in the order of the id, rows without an id first, rows of one id by digest; repeated rows are
leaves of their own. A null field counts as ``-``, an empty text as a value of no bytes; a text is hashed
whole, whatever its length. Rows without a language form a tree. Rows without an id are never tampered
with. An empty table has no leaves and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions.ranking import row_numbers
from rainloom.llm.common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64  # characters of a digest
LEVELS = 8  # levels of a block, which has 2 ** LEVELS leaves
BLOCK = 1 << LEVELS


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """Length and value of a field, so that no two rows have the same concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row, with some of its fields replaced."""
    return digest(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]))


def _shifted(value: Column, by) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def _parents(level: Column) -> Column:
    """The level above: a hash for every two digests; the last one may stand alone."""
    last = ((F.length(level) / HEX).cast("int") - 1) / 2
    pairs = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: digest(F.substring(level, i * (2 * HEX) + 1, F.lit(2 * HEX))))
    return F.array_join(pairs, "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, n, leaves (in order), levels (strings from the leaves up) and root of each aligned block.

    ``n`` counts the nodes of the tree. A tree of several blocks takes each of them up all levels; the only
    block of a tree ends with the level that has one node.
    """
    rows = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos", "n")])
    grouped = nodes.groupBy("tree", _shifted(F.col("pos"), LEVELS).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(rows)).alias("leaves")  # a block has BLOCK rows at most
    )
    steps = F.filter(F.array(*[F.lit(k) for k in range(LEVELS)]), lambda k: (F.col("n") > BLOCK) | (_shifted(F.col("n") - 1, k) > 0))
    lowest = F.array(F.array_join(F.transform("leaves", lambda x: x["hash"]), ""))
    built = grouped.withColumn("levels", F.aggregate(steps, lowest, lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1))))))
    return built.withColumn("root", F.element_at("levels", -1))


def prove(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the siblings on the way up as one string (proof) and the root of their tree.

    ``nodes``: tree, pos (from 0, gapless in a tree), n (nodes of the tree), hash, and what else is to be kept.
    """
    kept = [c for c in nodes.columns if c not in ("tree", "n")]
    blocks = materialize(_blocks(nodes), "blocks")
    most = blocks.agg(F.max("n")).first()[0] or 0
    above, root = F.lit(""), F.col("root")
    if most > BLOCK:
        tops = blocks.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), (_shifted(F.col("n") - 1, LEVELS) + 1).alias("n"), F.col("root").alias("hash"))
        upper = materialize(prove(tops).select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("proof").alias("_above"), F.col("root").alias("_root")), "upper")
        blocks = blocks.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")), "left")
        above, root = F.coalesce("_above", above), F.coalesce("_root", root)

    def sibling(x: Column, k: Column) -> Column:
        """The other digest of the run of two that holds node x at level k; empty if it stands alone."""
        at = _shifted(x["pos"] % BLOCK, k)
        return F.substring(F.get("levels", k), (at + F.when(at % 2 == 0, 1).otherwise(-1)) * HEX + 1, F.lit(HEX))

    ways = F.filter(F.array(*[F.lit(k) for k in range(LEVELS)]), lambda k: k < F.size("levels") - 1)
    proof = lambda x: F.concat(F.array_join(F.transform(ways, lambda k: sibling(x, k)), ""), F.col("_up"))
    proven = blocks.withColumns({"_up": above, "_top": root}).select(
        "tree", "n", F.col("_top").alias("root"), F.explode(F.transform("leaves", lambda x: F.struct(*[x[c].alias(c) for c in kept], proof(x).alias("proof")))).alias("x")
    )
    return proven.select("tree", "n", *[f"x.{c}" for c in kept], "x.proof", "root")


def fold(state: Column, pos: Column, n: Column, proof: Column) -> Column:
    """Walk from node ``pos`` of ``n`` up to the root with the siblings in ``proof``.

    ``state``: the digest so far and where in ``proof`` the next sibling starts.
    """

    def step(s: Column, k: Column) -> Column:
        at, other = _shifted(pos, k), F.substring(proof, s["at"], F.lit(HEX))
        left = at % 2 == 1
        paired = left | (at < _shifted(n - 1, k))
        text = F.when(left, F.concat(other, s["hash"])).when(paired, F.concat(s["hash"], other)).otherwise(s["hash"])
        return F.struct(digest(text).alias("hash"), (s["at"] + F.when(paired, HEX).otherwise(0)).alias("at"))

    levels = F.filter(F.array(*[F.lit(k) for k in range(63)]), lambda k: _shifted(n - 1, k) > 0)
    return F.aggregate(levels, state, step)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, tampered, pos, n, subroot, lang_pos, n_langs, root and proof of every row.

    ``proof`` is the string of siblings from the leaf by the root of its language to the root of all;
    ``tampered`` is the leaf of the row with one more in n_chars, where the id's check sum is divisible by 7.
    """
    more = leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf().alias("hash"), F.when(picked, more).alias("tampered"))
    ranked = row_numbers(leaves, ["doc_id", "hash"], ("tree",), "rn")
    trees = prove(ranked.select("tree", (F.col("rn") - 1).alias("pos"), F.col("rn_total").alias("n"), "hash", "doc_id", "tampered"))
    trees = materialize(trees, "trees")
    langs = row_numbers(trees.where("pos = 0").select(F.col("tree").alias("lang"), "root"), ["lang"], (), "rn")
    tops = prove(langs.select(F.lit(0).alias("tree"), (F.col("rn") - 1).alias("pos"), F.col("rn_total").alias("n"), F.col("root").alias("hash"), "lang"))
    tops = materialize(tops.select("lang", F.col("pos").alias("lang_pos"), F.col("n").alias("n_langs"), F.col("proof").alias("_rest"), F.col("root").alias("_root")), "tops")
    joined = trees.join(tops, F.col("tree").eqNullSafe(F.col("lang")))
    return joined.select("doc_id", "lang", F.col("hash").alias("leaf"), "tampered", "pos", "n", F.col("root").alias("subroot"), "lang_pos", "n_langs",
                         F.col("_root").alias("root"), F.concat("proof", "_rest").alias("proof"))


def folded(proven: DataFrame, start: Column) -> Column:
    """The root that ``start`` leads to with a row's proof."""
    first = F.struct(start.alias("hash"), F.lit(1).alias("at"))
    own = fold(first, F.col("pos"), F.col("n"), F.col("proof"))
    return fold(own, F.col("lang_pos"), F.col("n_langs"), F.col("proof"))["hash"]


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang."""
    proven = proofs(docs)
    out = proven.withColumn("folded_root", folded(proven, F.coalesce("tampered", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang")
