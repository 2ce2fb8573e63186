"""Repeated passages by super-k-mers: windows of words counted exactly in the buckets of their minimisers.

The minimiser of a window is its gram of words with the least hash. Consecutive windows with the same
minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket; equal windows have equal
minimisers, so all of them meet there and nowhere else. Equal strings are reduced to the earliest one
where they arise and again where they arrive, so a passage that many documents share costs its bucket one
string per slice of the input. Within a bucket the windows are sorted by a hash, neighbours are compared byte
by byte, and all but the earliest of each group are marked. A bucket whose different strings exceed a size (a
gram in very many contexts) is cut into single windows, which are dealt anew by a hash of all their words, so
no task holds all that one minimiser attracts, and the count stays exact.

The earlier window is the one of the smaller id, or at the smaller position of the same document. A document
is an id with a text: repeated rows are one document, an id that stands for several texts is several (in the
order of their hashes), and each row without an id is a document of its own, after all others. Null and empty texts have no words; texts shorter than a window lose none.
A very long text is a slice of its own, cut into windows whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import add_column, free_name, give_back, map_texts, materialize, narrow, parts
from rainloom.llm.shingles import mixed, word_hash

WINDOW = 20
GRAM = 4
BUCKET = 1 << 20  # bytes of text whose windows share a bucket
SLICE = 2 << 20  # bytes of a slice of the input
HEAVY = 16 << 20  # bytes of different strings, beyond which a bucket is dealt anew by whole windows
NO_ID = (1 << 63) - 1
_LOW = np.uint64((1 << 24) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of eight
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each ``k`` consecutive values, by doubling."""
    done, width, out, covered = h, 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, covered = done, width
            else:  # what is covered so far comes after ``width`` further values
                n = max(0, len(h) - covered - width + 1)
                out, covered = done[:n] * _power(covered) + out[width : width + n], covered + width
        if width * 2 > k:
            return out[: max(0, len(h) - k + 1)]
        n = max(0, len(done) - width)
        done, width = done[:n] * _power(width) + done[width : width + n], width * 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, eight bytes at a time; the same in every process."""
    eights = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))  # from each byte on
    h = mixed(eights[starts] & _FIRST[np.minimum(lengths, 8)] ^ lengths.astype(np.uint64) * _FACTOR)
    done, more = 8, np.flatnonzero(lengths > 8)
    while len(more) and done < 64:
        h[more] = mixed(h[more] * _FACTOR + (eights[starts[more] + done] & _FIRST[np.minimum(lengths[more] - done, 8)]))
        done += 8
        more = more[lengths[more] > done]
    h[more] = word_hash([data[a : a + k].tobytes() for a, k in zip(starts[more].tolist(), lengths[more].tolist())])
    return h


def _numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), number


def super_kmers(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text number, first window, number of windows, minimiser hash and packed words of each super-k-mer."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), []
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    keep = ~space
    keep[ends] = True
    lengths = ends - starts
    stops = np.cumsum(lengths + 1) - 1
    data = data[keep]  # words joined by one space
    data[stops] = 32
    grams = mixed(_rolled(_hashes(data, stops - lengths, lengths), gram))
    grams = grams & ~_LOW | np.arange(len(grams), dtype=np.uint64) & _LOW  # the leftmost of equal ones
    least, width, span = grams, 1, window - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - window + 1], least[span - width : span - width + n - window + 1])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(at):
        return none, none, none, none.view(np.uint64), []
    value = least[at]
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (value[1:] != value[:-1])])
    first, count = at[cut], np.diff(np.r_[cut, len(at)])
    whole = data.tobytes()
    begin, end = (stops - lengths)[first].tolist(), stops[first + count + window - 2].tolist()
    packed = [whole[a:b] for a, b in zip(begin, end)]
    text = owner[first]
    return text, first - bounds[text], count, mixed(value[cut] >> np.uint64(24)), packed


def _wrap(docs, rows, starts, counts, texts: list[bytes], lost: list[tuple[int, int, int, int]]) -> bytes:
    """One block for a bucket: strings with their places, and places that lost to an equal string already."""
    lost = np.array(lost, np.int64).reshape(-1, 4)
    head = np.array([len(texts), len(lost)], np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    places = np.concatenate([*(np.asarray(a, np.int64) for a in (docs, rows, starts, counts, sizes)), lost.reshape(-1)])
    planes = places.view(np.uint8).reshape(-1, 8).T.tobytes()  # equal bytes of numbers side by side
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), planes, *texts]))


def _unwrap(block: bytes):
    data = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(data, np.int64, 2)
    places = np.frombuffer(data, np.uint8, 40 * n + 32 * m, 16).reshape(8, -1).T.copy().view(np.int64).reshape(-1)
    docs, rows, starts, counts, sizes = places[: 5 * n].reshape(5, n)
    lost = places[5 * n :].reshape(m, 4)
    at, texts = 16 + 40 * int(n) + 32 * int(m), []
    for s in sizes.tolist():
        texts.append(data[at : at + s])
        at += s
    return docs, rows, starts, counts, texts, lost


def _earliest(docs: list[int], rows: list[int], starts: list[int], counts: list[int], texts: list[bytes], best: dict) -> list[tuple[int, int, int, int]]:
    """Keeps the earliest place of each string in ``best``; returns the places that lose."""
    lost = []
    for d, r, s, c, t in zip(docs, rows, starts, counts, texts):
        other = best.get(t)
        if other is None:
            best[t] = (d, r, s, c)
        elif (d, r, s) < other[:3]:
            best[t] = (d, r, s, c)
            lost.append(other)
        elif (d, r, s) > other[:3]:
            lost.append((d, r, s, c))
    return lost


def _dealt(docs, rows, starts, counts, key: np.ndarray, packed: list[bytes], buckets: int) -> dict:
    """Strings by the bucket of their key, equal ones reduced, a block for each bucket."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    out = {"bucket": [], "block": []}
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own, best = order[a:b], {}
        lost = _earliest(docs[own].tolist(), rows[own].tolist(), starts[own].tolist(), counts[own].tolist(), [packed[i] for i in own], best)
        d, r, s, c = zip(*best.values())
        out["bucket"].append(int(bucket[own[0]]))
        out["block"].append(_wrap(d, r, s, c, list(best), lost))
    return out


def _blocks(batch, buckets: int):
    raw = [t.as_buffer().to_pybytes() for t in batch.column("text")]
    text, starts, counts, minimiser, packed = super_kmers(raw)
    docs, rows = (batch.column(c).to_numpy(zero_copy_only=False)[text] if len(text) else text for c in ("doc_id", "row"))
    return _dealt(docs, rows, starts, counts, minimiser, packed, buckets)


def _alike(whole: bytes, begins: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> bool:
    """Whether the windows from the words ``a`` are those from the words ``b``; consecutive ones are compared at once."""
    order = np.argsort(b)
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (np.diff(b) != 1)]) if len(a) else order
    last = np.r_[cut[1:], len(a)] - 1 if len(a) else order
    places = (begins[a[cut]], ends[a[last] + window - 1], begins[b[cut]], ends[b[last] + window - 1])
    return all(whole[p:q] == whole[r:s] for p, q, r, s in zip(*(x.tolist() for x in places)))


def repeated(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, packed: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Rows (doc, first window, windows) of the windows of distinct strings that occur earlier."""
    order = np.lexsort((starts, docs))
    docs, starts, counts = docs[order], starts[order], counts[order]
    whole = b" ".join([packed[i] for i in order]) + b" "
    data = np.frombuffer(whole, np.uint8)
    ends = np.flatnonzero(data == 32)
    begins = np.r_[0, ends[:-1] + 1]
    length = counts + window - 1
    base = np.cumsum(length) - length
    total = int(counts.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    word, doc, place = np.repeat(base, counts) + inner, np.repeat(docs, counts), np.repeat(starts, counts) + inner
    key, seed, ids = _rolled(mixed(_hashes(data, begins, ends - begins)), window)[word], 0, None
    while True:
        sort = np.argsort(key, kind="stable")  # windows stand in order of document and position, and stay so
        same = np.flatnonzero(key[sort[1:]] == key[sort[:-1]])
        if _alike(whole, begins, ends, word[sort[same]], word[sort[same + 1]], window):
            break
        seed += 1  # two different windows have the same hash: other hashes, of numbered words
        if ids is None:
            ids, number = _numbered(whole[:-1].split(b" "))
        values = mixed(np.arange(1, len(number) + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
        key = _rolled(values[ids], window)[word]
    if not len(same):
        return np.zeros((0, 3), np.int64)
    leader = np.arange(total)
    leader[same + 1] = -1
    leader = np.maximum.accumulate(np.where(leader < 0, 0, leader))  # in sorted order, the first of each group
    first = sort[leader[same + 1]]
    gone = sort[same + 1]
    gone = np.sort(gone[(doc[gone] != doc[first]) | (place[gone] != place[first])])
    if not len(gone):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.r_[True, (np.diff(gone) != 1) | (doc[gone[1:]] != doc[gone[:-1]]) | (np.diff(place[gone]) != 1)])
    return np.stack([doc[gone[cut]], place[gone[cut]], np.diff(np.r_[cut, len(gone)])], 1)


def _count(batches, schema, heavy: int):
    """Rows come sorted by bucket; a bucket is counted when it is complete. Heavy buckets are left to _windows."""
    current, best, size, pending = None, {}, 0, []

    def emit(rows):
        rows = np.concatenate([np.array(r, np.int64).reshape(-1, 4) for r in rows])
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(rows[:, 3] + WINDOW - 1)], schema=schema)

    def done():
        d, r, s, c = (np.array(x, np.int64) for x in zip(*best.values()))
        order = np.lexsort((r, d))  # documents by number, in their order
        number = np.empty(len(d), np.int64)
        number[order] = np.cumsum(np.r_[False, (np.diff(d[order]) != 0) | (np.diff(r[order]) != 0)])
        at = np.empty(number.max() + 1, np.int64)
        at[number] = np.arange(len(d))
        gone = repeated(number, s, c, list(best))
        own = at[gone[:, 0]]
        return np.column_stack([d[own], r[own], gone[:, 1:]])

    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != current:
                if best:
                    pending.append(done())
                if pending:
                    yield emit(pending)
                current, best, size, pending = bucket, {}, 0, []
            d, r, s, c, texts, lost = _unwrap(block.as_buffer().to_pybytes())
            pending.append(lost)
            if size <= heavy:
                size += sum(len(t) for t in texts if t not in best)
                if size <= heavy:
                    pending.append(_earliest(d.tolist(), r.tolist(), s.tolist(), c.tolist(), texts, best))
                else:
                    best = {}
    if best:
        pending.append(done())
    if pending:
        yield emit(pending)
    give_back()


def _windows(batches, schema, buckets: int, heavy: int):
    """The strings of heavy buckets, cut into their windows, which are dealt by a hash of all their words.

    A bucket is heavy if its different strings have more than ``heavy`` bytes, in whatever order they come, so
    this and _count agree. What is held of it is dealt each time it exceeds that size.
    """
    current, held, raw, best, size, lost, split = None, [], 0, {}, 0, [], False

    def deal():
        texts, places = list(best), np.array(list(best.values()), np.int64).reshape(-1, 4)
        portion = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // (SLICE // 2)
        cuts = np.flatnonzero(np.r_[True, np.diff(portion) != 0]) if len(texts) else []
        for a, b in zip(cuts, [*cuts[1:], len(texts)]):
            text, first, counts, key, packed = super_kmers(texts[a:b], WINDOW, WINDOW)
            docs, rows, starts, _ = places[a:b][text].T
            out = _dealt(docs, rows, starts + first, counts, key, packed, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["block"], pa.binary())], schema=schema)
        if lost:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([_wrap([], [], [], [], [], lost)], pa.binary())], schema=schema)

    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != current:
                if split:
                    yield from deal()
                current, held, raw, best, size, lost, split = bucket, [], 0, {}, 0, [], False
            held.append(block.as_buffer().to_pybytes())
            raw += zstandard.frame_content_size(held[-1])
            if raw <= heavy:  # an upper bound of the size: most buckets are never unpacked here
                continue
            for data in held:
                d, r, s, c, texts, _ = _unwrap(data)
                size += sum(len(t) for t in texts if t not in best)
                lost += _earliest(d.tolist(), r.tolist(), s.tolist(), c.tolist(), texts, best)
                if size > heavy:
                    yield from deal()
                    best, size, lost, split = {}, 0, [], True
            held = []
    if split:
        yield from deal()
    give_back()


def _settle(batches, schema):
    """Single windows in buckets of their own hash: equal ones meet, all but the earliest are lost."""
    current, best = None, {}

    def emit(rows):
        rows = np.array(rows, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(rows[:, 3] + WINDOW - 1)], schema=schema)

    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != current:
                current, best = bucket, {}
            d, r, s, c, texts, lost = _unwrap(block.as_buffer().to_pybytes())
            yield emit([*lost.tolist(), *_earliest(d.tolist(), r.tolist(), s.tolist(), c.tolist(), texts, best)])
    give_back()


def passages(texts: DataFrame) -> DataFrame:
    """Spans (doc_id, row, start, n) of words that a window covers which occurs earlier; spans may overlap. Of _keyed.

    Both branches read the same shuffled blocks: one counts the buckets, the other cuts the heavy ones into windows.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = parts(texts, 32, 3 * size / 1e6)
    buckets, heavy = max(tasks, size // BUCKET + 1), HEAVY
    found, keyed = "doc_id long, row long, start long, n long", "bucket long, block binary"
    spans = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "start", "n")])
    block = pa.schema([("bucket", pa.int64()), ("block", pa.binary())])
    blocks = map_texts(texts, lambda b: _blocks(b, buckets), keyed, limit=SLICE)
    blocks = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    single = blocks.mapInArrow(lambda x: _windows(x, block, 8 * tasks, heavy), keyed)
    single = single.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(lambda x: _count(x, spans, heavy), found).unionByName(single.mapInArrow(lambda x: _settle(x, spans), found))


def _with_row(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a number that, together with the id, tells documents apart.

    It is a hash of the text where an id stands for several texts, else zero, which costs nothing on the way;
    rows without an id are numbered, and stored so that they keep their numbers.
    """
    number, digest = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    some, none = docs.where(number.isNotNull()), docs.where(number.isNull())
    per_id = some.groupBy(number.alias("_id")).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    several = materialize(per_id.where("a <> b").select(F.col("_id").alias(f"{row}_id")), "several")
    if several.isEmpty():
        some = some.withColumn(row, F.lit(0).cast("long"))
    else:
        marked = some.join(several, number == F.col(f"{row}_id"), "left")
        some = marked.withColumn(row, F.when(F.col(f"{row}_id").isNotNull(), digest).otherwise(F.lit(0))).drop(f"{row}_id")
    if none.select(id_col).isEmpty():
        return some
    return some.unionByName(materialize(none.withColumn(row, F.monotonically_increasing_id()), "without_id"))


def _keyed(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row and text (as bytes) of rows that have their number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(row).alias("row"), text.alias("text"))


def _kept(raw: bytes, starts: np.ndarray | None, sizes: np.ndarray | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the others joined by spaces."""
    words = raw.split()
    n = len(words)
    if starts is None or not len(starts):
        return n, 0, b" ".join(words)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.minimum(starts, n), 1)
    np.add.at(edges, np.minimum(starts + sizes, n), -1)
    stay = np.cumsum(edges)[:-1] == 0
    return n, int(n - stay.sum()), b" ".join(compress(words, stay.tolist()))


def _spans(texts: DataFrame) -> DataFrame:
    """_id, _row, starts, sizes: the spans of each document that has any; as many as its windows at most."""
    gone = passages(texts).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    return gone.agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batch):
        out = {"n_words": [], "n_removed": [], "kept_sha256": []}
        for raw, starts, sizes in zip(batch.column("text"), batch.column("starts"), batch.column("sizes")):
            spans = [np.asarray(x.values) if x.is_valid else None for x in (starts, sizes)]
            n, lost, text = _kept(raw.as_buffer().to_pybytes(), *spans)
            for c, x in zip(out.values(), (n, lost, hashlib.sha256(text).hexdigest())):
                c.append(x)
        return {"doc_id": batch.column("doc_id")} | out

    texts = _keyed(_with_row(narrow(docs, id_col, text_col), "row", "doc_id", "text"), "row", "doc_id", "text")
    joined = texts.join(_spans(texts), (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    cut = map_texts(joined.drop("_id", "_row", "row"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words joined by one space as text; all columns stay, a null text stays null."""
    spans, new, row = (free_name(docs, x) for x in ("spans", "kept", "row"))

    def text(batch):
        out = []
        for t, s in zip(batch.column(text_col), batch.column(spans)):
            own = [np.asarray(s[c].values) if s.is_valid else None for c in ("starts", "sizes")]
            out.append(_kept(t.as_py().encode(), *own)[2].decode() if t.is_valid else None)
        return pa.array(out, pa.string())

    rows = _with_row(docs, row, id_col, text_col)
    found = _spans(_keyed(rows, row, id_col, text_col)).select("_id", "_row", F.struct("starts", "sizes").alias(spans))
    same = (F.coalesce(F.col(f"docs.{id_col}").cast("long"), F.lit(NO_ID)) == found["_id"]) & (F.col(f"docs.{row}") == found["_row"])
    own = rows.alias("docs").join(found, same, "left")
    cut = add_column(own.select("docs.*", spans), new, "string", text, text_col)
    return cut.select(*[F.col(new).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
