"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.
A policy is a named, versioned mask of rules: a document is kept if no bit of the mask is set. Verdicts of
any policy and ablations (what a policy would lose or win without a rule) come from the stored bits alone.

A null or empty text has no words; it fails ``few_words``. Very long texts are measured whole, an empty table
gives no rows. Rows are independent, so repeated rows give repeated
ledgers. Rules compare whole numbers only, so that they give the same answer everywhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import add_column, free_name, map_texts, narrow

MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_marked".split()

#: Rules by bit: the condition (over the measures) under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 4 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "upper_case": "10 * n_upper > 4 * n_letters",
    "marked_words": "10 * n_marked > 4 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Policies by name and version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base@1": ("few_words", "repeated_words"),
    "web@1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_or_long_words"),
    "web@2": tuple(RULES),
}
CURRENT = "web@2"

_SYMBOLS = b"#*$%&|<>"
_REPEATED_MARK = re.compile(r"(?:!!|\?\?|[#*$%&|<>]{2,})[.,;:]?$")


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def measure(raw: bytes) -> tuple[int, ...]:
    """``MEASURES`` of a text in UTF-8."""
    words = raw.split()  # ASCII white space, as the words' pattern says
    n = len(words)
    inner = b"".join(words)
    chars = len(inner.decode()) if not inner.isascii() else len(inner)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    text = inner.decode()
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = len(text) - len(re.sub(r"[A-ZÀ-ÖØ-Þ]", "", text))
    marked = sum(1 for w in words if w[-1] in b"!?#*$%&|<>.,;:" and _REPEATED_MARK.search(w.decode()))
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines), upper, letters, marked


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) >= 1 << 21:  # three numbers no longer fit in one
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    else:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def failures(book: str = "") -> Column:
    """The failure bits of a row that has the measures, as columns or in the struct ``book``."""
    named = lambda rule: re.sub(r"\b(\w*_\w+)\b", rf"`{book}`.\1", rule) if book else rule
    bits = [F.when(F.expr(named(rule)), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("int")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures and ``failed``, the bits of the rules that the document fails."""

    def run(batch):
        rows = [measure(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        return {"doc_id": batch.column("doc_id")} | {c: pa.array(x, pa.int64()) for c, x in zip(MEASURES, zip(*rows))}

    raw = narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    measured = map_texts(raw, run, "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES))
    return measured.withColumn("failed", failures())


def passed(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the policy reject, with all their columns."""
    book = free_name(docs, "ledger")

    def measured(batch):
        rows = [measure((t.as_py() or "").encode()) for t in batch.column(text_col)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], MEASURES)

    judged = add_column(docs, book, f"struct<{', '.join(f'{c}: long' for c in MEASURES)}>", measured, text_col)
    mask_ = F.lit(mask(policy) | mask("base@1"))
    return judged.where(failures(book).bitwiseAND(mask_) == 0).drop(book)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, how many only it rejects, and what is kept without it.

    Documents are counted by their bits first, so all rules together need one small aggregate.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    out = []
    for rule in POLICIES[policy]:
        own, rest = F.lit(BIT[rule]), F.lit(mask(policy) & ~BIT[rule])
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
        out.append(
            patterns.agg(
                count(F.col("bits").bitwiseAND(own) != 0)("n_failed"),
                count(F.col("bits") == own)("n_only"),
                count(F.col("bits").bitwiseAND(rest) == 0)("n_kept_without"),
            ).select(F.lit(rule).alias("rule"), "*")
        )
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def judge(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and the verdict, false wherever the base rules fail."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base@1"))) != 0
    return apply_policy(ledger(docs, id_col, text_col), policy).withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~base)
