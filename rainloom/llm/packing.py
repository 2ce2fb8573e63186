"""Packing of token sequences by minimum bin slack.

Documents are cut at multiples of the window; a full piece is a sequence of its own. The rests are packed
through the histogram of their lengths, which has fewer entries than the window has tokens: the largest
length left goes in, and a subset-sum bitset over the multiset of lengths left picks what fills the window
closest to its end. The same filling repeats as often as the counts allow, so there are at most as many
fillings as lengths times a few, whatever the number of documents. Each rest then finds its place from
its rank among the rests of its length.

Null and empty texts are one piece of the end id. A very long text is cut like any other, one row at a time.
Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.functions.ranking import row_numbers
from rainloom.llm.common import map_texts, materialize, narrow
from rainloom.llm.tokens import ids, vocabulary

WINDOW = 4096
END = 2


def fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths with the largest sum up to ``room``; subset sums are the bits of a number."""
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(lengths, reverse=True):
        count, share = min(lengths[length], room // length), 1
        while count > 0:  # 1, 2, 4, ... and the rest of the copies
            take = min(share, count)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & mask
            count -= take
            share *= 2
        if reached >> room & 1:
            break
    total, out = reached.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] += take
            total -= length * take
    return dict(out)


def fillings(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, counts by length) of windows that take every length as often as it occurs."""
    left, out = dict(histogram), []
    while left:
        largest = max(left)
        rest = {k: n - (k == largest) for k, n in left.items() if n > (k == largest) and k <= window - largest}
        counts = fill(rest, window - largest)
        counts[largest] = counts.get(largest, 0) + 1
        times = min(left[k] // n for k, n in counts.items())
        for k, n in counts.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, counts))
    return out


def _places(spark, plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """For each filling and length: ranks from ``low`` on, ``each`` in a window, the first at ``place``."""
    used, base, rows = Counter(), 0, []
    for times, counts in plan:
        place = 0
        for length, n in sorted(counts.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, base, place))
            used[length] += n * times
            place += length * n
        base += times
    return spark.createDataFrame(rows, "length long, low long, high long, each long, base long, place long")


def cut(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    path = path or vocabulary()

    def run(batch):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = ids(path).text(text) + END.to_bytes(4, "little")
            n = len(data) // 4
            rows += [(doc, s, min(window, n - s), zlib.crc32(data[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows)))

    return map_texts(narrow(docs, id_col, text_col), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and the offset there."""
    spark = docs.sparkSession
    cut_up = materialize(cut(docs, path, window, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    full = histogram.pop(window, 0)
    plan = fillings(histogram, window)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked = row_numbers(cut_up, order, ("length",), "_r").withColumn("_r", F.col("_r") - 1)
    whole = ranked.where(F.col("length") == window).select(*cut_up.columns, F.col("_r").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # fillings by length are bounded by the window, not by the rows
    places = F.broadcast(_places(spark, plan))
    rest, turn = ranked.where(F.col("length") < window).join(places, "length"), F.col("_r") - F.col("low")
    rest = rest.where((F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high"))).select(
        *cut_up.columns,
        (F.col("base") + F.lit(full) + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(turn, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
    return whole.unionByName(rest)
