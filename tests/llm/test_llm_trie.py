"""The prefix trie against nested dictionaries, and parentheses against a stack."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rainloom.llm import trie
from rainloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not kids[p]
    out = Counter()
    for p, m in members.items():
        ends = sha(",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends)] += 1
    return out


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, folder):
    path = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    df = QUERIES["op12_prefix_trie"](spark, path)
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    got = rows_of(df)
    assert got == expected(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    cur = con.execute(ORACLE_SQL["op12_prefix_trie"])
    names = [c[0] for c in cur.description]
    assert got == Counter(tuple(dict(zip(names, r))[c] for c in COLUMNS) for r in cur.fetchall())


def conversations(seed, n, words=2, long=6):
    """Conversations that share many beginnings."""
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice("xyz"[:words])) for c in range(n) for t in range(rng.randrange(long))]


@pytest.mark.parametrize("seed", range(2))
def test_shared_beginnings(spark, seed):
    rows = conversations(seed, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        assert rows_of(trie.build(df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_conversation_in_slices(spark, monkeypatch):
    """One conversation with most of the rows, two that follow it far down, and pieces of a list of ends."""
    monkeypatch.setattr(trie, "SLICE", 4)
    monkeypatch.setattr(trie, "TAIL", 16)
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(5 * k, t, "u", f"t{t}") for k, n in ((0, 400), (1, 90), (2, 90)) for t in range(n)] + [(5 * k, 0, "u", "t0") for k in range(3, 120)]
    assert rows_of(trie.build(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_edges(spark):
    rows = [(None, 0, "u", "lost"), (1, None, None, None), (1, None, "u", ""), (1, 2, "u", "a"), (1, 2, "u", "a"), (1, 2, "a", "a"), (-7, 3, None, "é" * 70_000), (-5, 1, None, "é" * 70_000), (7, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.build(df.selectExpr("*", "1 AS depth", "2 AS pos", "'x' AS s1", "3 AS len", "4 AS n"))) == expected(rows)
    assert trie.build(df.limit(0)).count() == 0
    assert trie.build(df.where("conv_id IS NULL")).count() == 0


def test_no_turns_left(spark):
    """Conversations without a base that lose all their turns end at the root, which is then a leaf."""
    ids = [c for c in range(200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:5]
    rows = [(c, 0, "u", "x") for c in ids]
    got = rows_of(trie.build(spark.createDataFrame(rows, SCHEMA)))
    assert got == expected(rows) and len(got) == 1


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 200, 3000])
def test_parentheses(n):
    rng = random.Random(n)
    for shape in (0.1, 0.5, 0.9):
        bits, open_, left = [1], 1, n - 1
        while open_:
            if left and (open_ == 1 or rng.random() < shape):
                bits.append(1)
                open_, left = open_ + 1, left - 1
            else:
                bits.append(0)
                open_ -= 1
                if not open_ and left:
                    bits[-1:] = [1]
                    open_, left = 2, left - 1
        stack, partner = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                partner[stack.pop()] = i
        bits = np.array(bits, np.uint8)
        opens = np.flatnonzero(bits)
        assert trie.Parentheses(bits).close(opens).tolist() == [partner[i] for i in opens.tolist()]
