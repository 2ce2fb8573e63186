"""The corpus pipeline: quality rules, near-duplicate removal, removal of repeated passages, packing.

The stages take what their operators take: null and empty texts (no words: the rules reject them), texts of
any length (whole), repeated rows (one document to the stages that compare, as many to the others), rows
without an id (never a duplicate), further columns of any name, and empty tables (no rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import packing, quality, shingles, substrings
from rainloom.llm.common import documents, materialize

#: Near duplicates of the pipeline share this part of their shingles of 5 words, in percent; op10 has its own limit.
NEAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.passed(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return shingles.deduplicated(docs, NEAR)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; the count of characters follows."""
    return substrings.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("repeated passages", cut_repeated),
    ("packing", pack),
]

#: The stages are not expressible in SQL (vocabulary, packing); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
