"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from rainloom.llm import merkle
from rainloom.llm.queries import ORACLE_SQL, QUERIES
from tests_llm_data import AWKWARD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    out = ""
    for k, v in enumerate(row):
        v = v + more if k == 3 and v is not None else v
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    return levels


def way(levels, i):
    """(siblings before, siblings after) of node i, level by level."""
    out = []
    for low in levels[:-1]:
        a = i - i % 2
        out.append((low[a:i], low[i + 1 : a + 2]))
        i //= 2
    return out


def expected(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, levels_of([leaf_of(r) for r in own])
    tops = levels_of([t[1][-1][0] for t in trees.values()])
    out = Counter()
    for k, (own, levels) in enumerate(trees.values()):
        for i, r in enumerate(own):
            path = way(levels, i) + way(tops, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of(r, int(tampered))
            for before, after in path:
                h = sha("".join(before) + h + "".join(after))
            root = tops[-1][0]
            out[(r[0], levels[0][i], levels[-1][0], root, sha("".join("".join(b + a) for b, a in path)), h, h == root)] += 1
    return out


def rows_of(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def test_whole_table(spark, data_dir):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{data_dir}/documents.parquet'").fetchall()
    got = rows_of(QUERIES["op11_merkle_manifest"](spark, data_dir))
    assert got == expected(rows)
    assert {k[-1] for k in got} == {True, False}


def test_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    cur = con.execute(ORACLE_SQL["op11_merkle_manifest"])
    names = [c[0] for c in cur.description]
    df = QUERIES["op11_merkle_manifest"](spark, data_dir)
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, cur.fetchall())) == Counter(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 256, 600])
def test_sizes(spark, n):
    rows = [(k, f"s{k % 3}", "one" if k % 50 else None, k, f"text {k}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(df)) == expected(rows)


def test_three_rounds(spark, monkeypatch):
    """Small blocks: roots of roots of blocks."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(k, None, ["a", "b", "é", None, "c", "d"][k % 6 if k < 30 else 0], 1, "x") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(df)) == expected(rows)


def test_edges(awkward, empty, make_docs):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in awkward.collect()]
    assert len(rows) == len(AWKWARD)
    assert rows_of(merkle.manifest(awkward)) == expected(rows)
    assert merkle.manifest(empty).count() == 0


def test_largest_count(spark):
    """One more than the largest integer is no overflow."""
    d = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 0)
    rows = [(d, "s", "l", (1 << 63) - 1, "t"), (d, "s", "l", None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = rows_of(merkle.manifest(df))
    assert got == expected(rows) and {k[-1] for k in got} == {True, False}
