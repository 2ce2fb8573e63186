"""Near duplicates by circulant MinHash, with links confirmed on full shingle sets.

One permutation scatters the cells of the shingles, a second one, shifted round by 0, 1, 2, ... cells, gives
all signature coordinates. Bands of coordinates bring candidates together; candidates that hang together
form blocks of bounded size, and within a block every pair that shares shingles is counted exactly.

Texts with the same set are one class from the start, so copies never meet in a block. Large sets of
candidates are cut into chunks by hash, and each two chunks are one block, so that no task gets a whole
group. A document without words is in no class and linked with nothing; one with fewer words than a
shingle has them all as its only shingle. Repeated rows are documents of the same class; an id that stands
for several texts is one document linked through each of them. Documents without an id are linked with nothing.
The shingles of a very long text are counted whole, in a slice of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import ASCII_LOWER, bounded, map_texts, materialize, narrow
from rainloom.llm.components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 36, 7  # for PERCENT; see banding
CELLS = 1 << 20
CHUNK = 256  # documents


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_words(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words end."""
    number: dict[bytes, int] = {}
    ids, ends, n = [], [], 0
    for t in texts:
        ws = (t.translate(ASCII_LOWER) if lower else t).encode().split()
        for w in ws:
            if w not in number:
                number[w] = len(number)
        ids.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
        n += len(ws)
        ends.append(n)
    known = word_hash(list(number))
    return (known[np.concatenate(ids)] if ids and n else np.zeros(0, np.uint64)), np.array(ends, np.int64)


def sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    h, ends = hashed_words(texts, lower=True)
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * factor + h[j : j + len(rolled)]
    rolled = mixed(rolled)
    out, start = [], 0
    for end in ends:
        n = end - start
        if n >= k:
            out.append(np.unique(rolled[start : end - k + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for x in h[start:end]:
                whole = whole * factor + x
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands, and rows of a band, by which a pair at the limit is missed with a probability below 1e-6.

    As many rows as BANDS bands allow, so that few others become candidates; limits too low for that take more bands.
    """
    if percent >= 100:
        return 1, ROWS
    for rows in range(ROWS, 0, -1):
        n = math.ceil(math.log(1e-6) / math.log1p(-((percent / 100) ** rows)))
        if n <= BANDS:
            break
    return n, rows


@lru_cache(maxsize=2)
def _circle(coordinates: int) -> np.ndarray:
    """Row c has the second permutation's values for cell c under every shift."""
    values = np.argsort(mixed(np.arange(1, CELLS + 1, dtype=np.uint64))).astype(np.uint32)
    ring = np.concatenate([values, values[: coordinates - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The least value of the set in each coordinate."""
    circle, out = _circle(coordinates), np.full(coordinates, CELLS, np.uint32)
    # the first permutation: an odd factor and a fold are bijections of the cells; distinct shingles may share a cell
    cell = (shingles >> np.uint64(44)).astype(np.uint32)
    cell = (cell * np.uint32(0x9E375)) & np.uint32(CELLS - 1)
    cell ^= cell >> np.uint32(11)
    for at in range(0, len(cell), 512):
        np.minimum(out, circle[cell[at : at + 512]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band."""
    x = np.zeros(len(sig) // rows, np.uint64)
    for c in sig.reshape(-1, rows).T:
        x = mixed(x * np.uint64(31) + c.astype(np.uint64) + np.uint64(1))
    return x.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, ``class`` (digest of the set; null if empty) and the hashes of the bands for ``percent``."""
    n, rows = banding(percent)

    def run(batch):
        found = sets(batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": [len(s) for s in found],
            "class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found],
            "bands": pa.array([bands(signature(s, n * rows), rows) if len(s) else [] for s in found], pa.list_(pa.int64())),
        }

    return map_texts(narrow(docs, id_col, text_col), run, "doc_id long, n_shingles long, class binary, bands array<long>")


# --- candidates and blocks ----------------------------------------------------------


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all members of a band's bucket to its least member."""
    members = reps.select(F.col("rep").alias("b"), F.posexplode("bands").alias("band", "hash"))
    hubs = members.groupBy("band", "hash").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(hubs, ["band", "hash"]).where("a < b").select("a", "b").distinct()


def blocks(groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, block): each group of candidates in blocks of at most about two chunks; every pair of members shares one."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = groups.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select("id", F.struct("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("block"))


def links(found: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with ``100 * intersection >= percent * union``.

    Pairs meet through an inverted index of their shingles; pairs that are joined already are not counted anew.
    """
    n = len(found)
    sizes = np.array([len(s) for s in found])
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(found)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
    keep = np.diff(np.r_[starts, len(flat)]) > 1
    owner, run = owner[keep[run]], run[keep[run]]
    if not len(owner):
        return []
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    last = np.r_[first[1:], len(run)]
    place = np.repeat(np.arange(len(first)), last - first)
    by_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_owner], np.arange(n + 1))
    root, out = np.arange(n), []
    for a in range(n - 1):
        mine = by_owner[bounds[a] : bounds[a + 1]]
        if not len(mine):
            continue
        stop, begin = last[place[mine]], mine + 1  # owners of a run ascend, so the rest of it is later documents
        lengths = stop - begin
        total = int(lengths.sum())
        if not total:
            continue
        index = np.repeat(begin - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)
        common = np.bincount(owner[index], minlength=n)
        hit = np.flatnonzero(100 * common >= percent * (sizes[a] + sizes - common))
        for b in hit[hit > a]:
            if root[a] != root[b]:
                out.append((a, int(b)))
                root[root == root[b]] = root[a]
    return out


def _verify(batches, percent: int):
    """Rows come sorted by block; each block is counted when it is complete."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    current, ids, texts, seen = None, [], [], set()

    def done():
        found = links(sets(texts), percent) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], schema=schema)

    for batch in bounded(batches, "text"):
        for block, i, t in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if block != current:
                if ids:
                    yield done()
                current, ids, texts, seen = block, [], [], set()
            if (i, t) not in seen:  # a repeated row
                seen.add((i, t))
                ids.append(i)
                texts.append(t)
    if ids:
        yield done()


def _same_id(classed: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the classes of every id that stands for several texts."""
    several = classed.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("doc_id")
    own = classed.join(materialize(several, "several"), "doc_id").join(reps.select("class", "rep"), "class").select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own.join(least, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable) and whether it is the document's own."""
    texts = narrow(docs, id_col, text_col)
    signed = materialize(signatures(docs, id_col, text_col, percent), "signed")
    classed = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    reps = materialize(classed.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "representatives")
    groups = components(materialize(candidate_edges(reps), "candidates"), "candidates")
    placed = materialize(blocks(groups), "blocks")
    shown = placed.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    key = F.concat_ws("/", "block.component", "block.i", "block.j").alias("key")
    checked = shown.select(key, "id", "text").repartition("key").sortWithinPartitions("key", "id")
    confirmed = checked.mapInArrow(lambda batches: _verify(batches, percent), "a long, b long").where("a <> b").distinct()
    linked = confirmed.unionByName(_same_id(classed, reps))
    joined = components(materialize(linked, "links"), "links").withColumnRenamed("id", "rep")
    named = reps.join(joined, "rep", "left").select(F.col("class").alias("_class"), F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, F.col("class") == F.col("_class"), "left")
    own = F.when(F.col("class").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for the documents whose component has a smaller id; all columns stay.

    Rows of the same id are one document and stay together; rows without an id all stay.
    """
    lost = near_duplicates(docs, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(materialize(lost, "lost"), F.col(id_col) == F.col("_lost"), "left_anti")
