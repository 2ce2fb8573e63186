"""Quality ledger, license scan and shards against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from rainloom.llm import licenses, quality, sharding
from rainloom.llm.queries import QUERIES
from tests_llm_data import AWKWARD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_ledger(got, rows):
    expected = Counter()
    for d, t in rows:
        m = base_measures(t)
        expected[(d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_ledger_on_whole_table(spark, data_dir, texts):
    got = QUERIES["op9_quality_ledger"](spark, data_dir).collect()
    check_ledger(got, texts)
    by = {r["doc_id"]: r for r in got}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    assert all(by[d]["kept"] or by[d]["base_failed"] for d, good in labels.items() if good)
    junk = [d for d, good in labels.items() if not good]
    assert sum(not by[d]["kept"] for d in junk) >= 0.9 * len(junk)


def test_ledger_edges(awkward, empty):
    check_ledger(quality.judge(awkward).collect(), AWKWARD)
    assert quality.judge(empty).count() == 0
    assert quality.passed(empty).count() == 0
    kept = quality.passed(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(awkward).where("kept").collect()}


def test_policies_and_ablation(awkward):
    book = quality.ledger(awkward).cache()
    rows = [r["failed"] for r in book.collect()]
    for policy, rules in quality.POLICIES.items():
        mask = sum(quality.BIT[r] for r in rules)
        assert quality.apply_policy(book, policy).where("kept").count() == sum(not f & mask for f in rows)
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality.ablation(book, policy).collect()}
        for rule in rules:
            bit = quality.BIT[rule]
            assert got[rule] == (sum(bool(f & bit) for f in rows), sum(f & mask == bit for f in rows), sum(not f & mask & ~bit for f in rows))


# --- licenses ------------------------------------------------------------------------

LICENSE_ROWS = [
    (1, "x CC BY CC BY-NC 4.0 cc\nby."), (2, "MIT, license! The Apache.License and a GNU GENERAL public license"), (3, "mit x license"), (4, None), (5, ""),
    (6, "Permission is hereby granted, free of charge, to any person getting a copy of this software and its associated documentation files (the Software), to deal in the Software without any restriction"),
    (7, "gnu general public licence"), (8, "Apache Licensé"), (9, "apache license" + " apache license" * 5000), (10, "mit license"), (10, "mit license"), (None, "cc by"),
    (11, "Redistribution and use in source forms are nice"),
]


def base_places(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check_licenses(got, rows):
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *base_places(t)) for d, t in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_on_whole_table(spark, data_dir, texts):
    check_licenses(QUERIES["op7_license_scan"](spark, data_dir).collect(), texts)


def test_licenses_by_hand(make_docs, awkward, empty):
    got = licenses.scan(make_docs(LICENSE_ROWS)).collect()
    check_licenses(got, LICENSE_ROWS)
    by = {r["doc_id"]: r for r in got}
    assert "cc-by-nc" not in by[1]["base_labels"] and by[6]["labels"] == "mit-grant" and 0.8 <= by[6]["score"] < 1
    assert by[11]["labels"] == "" and by[7]["labels"] == "" and by[10]["score"] == 1
    check_licenses(licenses.scan(awkward).collect(), AWKWARD)
    assert licenses.scan(empty).count() == 0


# --- shards --------------------------------------------------------------------------


def test_rooms_tree_against_a_list():
    rng, rooms, plain = random.Random(4), sharding.Rooms(), []
    for _ in range(3000):
        if plain and rng.random() < 0.4:
            x = rng.choice(plain)
            plain.remove(x)
            rooms.drop(x)
        else:
            x = (rng.randrange(200), rng.randrange(10**6))
            plain.append(x)
            rooms.add(x)
        size = rng.randrange(220)
        assert rooms.tightest(size) == min((p for p in plain if p[0] >= size), default=None)
    assert sharding._height(rooms.root) <= 1.45 * (len(plain) + 2).bit_length()


def test_best_fit_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(100):
        sizes = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(80))), reverse=True)
        left, expected = [], []
        for s in sizes:
            fits = [(r, b) for b, r in enumerate(left) if r >= s]
            b = min(fits)[1] if fits else len(left)
            if not fits:
                left.append(100)
            left[b] -= s
            expected.append(b)
        assert sharding.best_fit(sizes, 100) == expected


def check_shards(got, rows, even=None):
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    by, load = {}, Counter()
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if even:
        assert len(load) == 16 and max(load.values()) - min(load.values()) <= even * sum(load.values()) / 16


def test_shards_on_whole_table(spark, data_dir, texts):
    got = QUERIES["op4_best_fit_shards"](spark, data_dir).collect()
    check_shards(got, texts, even=0.02)
    home = {r["doc_id"]: r["shard"] for r in got}
    by_text = {}
    for d, t in texts:
        by_text.setdefault(t, set()).add(home[d])
    assert all(len(s) == 1 for s in by_text.values())


def test_shard_edges(make_docs, awkward, empty):
    check_shards(sharding.shard(awkward).collect(), AWKWARD)
    assert sharding.shard(empty).count() == 0
    # a group with a third of everything stays whole; the others share the rest
    rows = [(k, "hot " * 50) for k in range(100)] + [(1000 + k, f"text {k} " * 20) for k in range(300)]
    got = sharding.shard(make_docs(rows)).collect()
    check_shards(got, rows)
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) == 1
    rest = Counter()
    for r in got:
        if r["doc_id"] >= 1000:
            rest[r["shard"]] += r["size"]
    assert len(rest) == 15 and max(rest.values()) < 1.1 * min(rest.values())


def test_fixed_capacity(make_docs):
    rows = [(k, "x" * (k % 50)) for k in range(200)]
    docs = make_docs(rows)
    sizes = Counter()
    for r in sharding.shard(docs, capacity=500).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 500 and len(sizes) <= -(-sum(sizes.values()) // 500) + 1
    with pytest.raises(ValueError):
        sharding.shard(docs, capacity=20)


@pytest.mark.parametrize("seed", range(4))
def test_counts_fill_like_single_items(seed):
    rng = random.Random(seed)
    for _ in range(150):
        capacity = rng.randrange(1, 80)
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))), reverse=True)
        plan = sharding.fill_by_count(Counter(sizes), capacity)
        load, placed = Counter(), Counter()
        for size, low, high, first, each in plan:
            assert low == placed[size]
            placed[size] = high
            for rank in range(low, high):
                load[first + (rank - low) // each] += size
        assert placed == Counter(sizes)
        single = Counter()
        for size, b in zip(sizes, sharding.best_fit(sizes, capacity)):
            single[b] += size
        assert sorted(load.values()) == sorted(single.values()) and set(load) == set(range(len(load)))


def test_small_capacity(spark):
    """Thousands of shards, each with room for one document or two."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id, repeat('x', CAST(id % 90 AS INT))) AS text")
    got = sharding.shard(docs, capacity=150).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == 5000 and max(load.values()) <= 150
    sizes = sorted((r["size"] for r in got), reverse=True)
    assert len(load) == max(sharding.best_fit(sizes, 150)) + 1
