"""Helpers shared by the operators: reading, Arrow batches of bounded size, word caches, shared tables."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.session import discard, materialize

__all__ = ["ASCII_LOWER", "Cache", "add_column", "bounded", "discard", "documents", "free_name", "give_back", "map_texts", "materialize", "narrow", "parts", "utf8"]

#: What ``str.translate`` needs to lower A-Z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that further columns of any name can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column``; a longer row comes alone."""
    some = False
    for batch in batches:
        if not batch.num_rows:
            continue
        some = True
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    if some:
        forget()
    give_back()


def forget() -> None:
    """Empty the word caches that nothing has used since the last call: the worker has gone on to another operator."""
    for cache in list(_caches):
        if not cache.used:
            cache.new, cache.old = {}, {}
        cache.used = False


def give_back() -> None:
    """Return freed memory to the system: workers live on, and other stages share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, column: str = "text", limit: int = 2 << 20) -> DataFrame:
    """``fn`` over slices of bounded size; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in bounded(batches, column, limit):
            out = fn(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def add_column(df: DataFrame, name: str, kind: str, fn: Callable[[pa.RecordBatch], pa.Array], column: str = "text", limit: int = 2 << 20) -> DataFrame:
    """``df`` with a further column that ``fn`` computes from slices of bounded size; all others pass through."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    def run(batches):
        for batch in bounded(batches, column, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, fn(batch)], names=[*batch.schema.names, name])

    added = _parse_datatype_string(f"`{name}` {kind}").fields
    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    return next(n for k in range(len(df.columns) + 1) if (n := f"_{stem}{k}") not in df.columns)


#: The caches of this process, of whichever operators it has worked for.
_caches: weakref.WeakSet[Cache] = weakref.WeakSet()


class Cache:
    """Results by word, in two generations: the older one is dropped when the younger is full.

    Words above ``LONG`` are not kept, so that the entries have a bounded size (a result is no longer than a few times its word).
    """

    LONG = 128

    def __init__(self, limit: int = 400_000):
        self.limit, self.new, self.old, self.used = limit, {}, {}, True
        _caches.add(self)

    def all(self, words: list, make: Callable[[list], list]) -> list:
        """A result for each word; ``make`` gets those not met lately, each once."""
        self.used = True
        get = self.new.get
        found = list(map(get, words))
        if None in found:
            places = [i for i, r in enumerate(found) if r is None]
            old, missing = self.old, dict.fromkeys(map(words.__getitem__, places))
            fresh = [w for w in missing if w not in old]
            made = dict(zip(fresh, make(fresh))) if fresh else {}
            self.new |= {w: made[w] if w in made else old[w] for w in missing}
            for i in places:
                found[i] = get(words[i])
            for w in [w for w in fresh if len(w) > self.LONG]:
                del self.new[w]
            if len(self.new) > self.limit:
                self.old, self.new = self.new, {}
        return found


def parts(df: DataFrame, megabytes: float, total_mb: float) -> int:
    """Partitions of about ``megabytes`` for ``total_mb``, and no fewer than the session's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total_mb / megabytes) + 1)
