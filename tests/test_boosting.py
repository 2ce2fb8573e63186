"""Exact boosted trees against a plain search, running sums against cumulative ones."""

import random

import pytest
from pyspark.sql import functions as F

from rainloom.functions.ranking import running_sums
from rainloom.plans import boosting

P = ("a", "b")


def best(rows):
    """(gain, predictor, value) of the best cut of rows (residual, weight, a, b)."""
    found = []
    s, w = sum(r[0] * r[1] for r in rows), sum(r[1] for r in rows)
    for k, p in enumerate(P, 2):
        for v in sorted({r[k] for r in rows})[:-1]:
            left = [r for r in rows if r[k] <= v]
            sl, wl = sum(r[0] * r[1] for r in left), sum(r[1] for r in left)
            found.append((sl**2 / wl + (s - sl) ** 2 / (w - wl) - s**2 / w, p, v))
    return max(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for k in range(400):
        a, b = float(rng.randrange(12)), rng.random()
        out.append((k, 2.0 * (a > 5) + (b > 0.7) + rng.gauss(0, 0.3), rng.choice([1.0, 2.0]), a, b, k % 4 > 0))
    return out


def test_trees(spark, rows):
    df = spark.createDataFrame(rows, "id long, y double, w double, a double, b double, train boolean")
    model = boosting.fit_exact(df, "y", P, rounds=2, depth=2, rate=0.5, weight="w")
    train = [r for r in rows if r[5]]
    start = sum(r[1] * r[2] for r in train) / sum(r[2] for r in train)
    pred = {r[0]: start for r in rows}
    for tree in model.trees:
        node = dict.fromkeys(pred, 1)
        for level in range(2):
            for k in range(1 << level, 2 << level):
                gain, p, v = best([(r[1] - pred[r[0]], *r[2:5]) for r in train if node[r[0]] == k])
                assert tree.splits[k][0] == p and tree.splits[k][1] == v
                assert next(f[3] for f in tree.found if f[0] == k) == pytest.approx(gain)
                for r in rows:
                    if node[r[0]] == k:
                        node[r[0]] = 2 * k + (r[3 if p == "a" else 4] > v)
        for k in set(node.values()):
            own = [r for r in train if node[r[0]] == k]
            leaf = sum((r[1] - pred[r[0]]) * r[2] for r in own) / sum(r[2] for r in own)
            for i in pred:
                pred[i] += 0.5 * leaf if node[i] == k else 0
    got = df.select("id", model.predict({p: F.col(p) for p in P}).alias("x")).collect()
    assert all(r.x == pytest.approx(pred[r.id]) for r in got)


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, True), (2.0, 2.0, 3.0, True)], "y double, a double, b double, train boolean")
    model = boosting.fit_exact(df, "y", P, rounds=2, depth=2)
    assert [t.splits for t in model.trees] == [{}, {}] and boosting.splits_of(model, spark).count() == 0
    assert {r.x for r in df.select(model.predict({p: F.col(p) for p in P}).alias("x")).collect()} == {1.5}


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.05)], "l int, s double")
    r = boosting.average_precision(df, "l", F.col("s")).first()
    assert r.pr_auc == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3) and r.prevalence == 0.5 and r.n == 6


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xxxxy"), k, rng.randrange(9), rng.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, s long, w long")
    for r in running_sums(df, ("g",), "k", ["s", "w"]).collect():
        own = [x for x in rows if x[0] == r.g]
        assert r.s_upto == sum(x[2] for x in own if x[1] <= r.k) and r.w_total == sum(x[3] for x in own)
        assert r["last"] == (r.k == max(x[1] for x in own))
    assert running_sums(df.limit(0), ("g",), "k", ["s"]).count() == 0
