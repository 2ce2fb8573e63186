"""Learning from positives and unlabelled texts: held-out accuracy, risk against its definition, edges."""

import zlib

import numpy as np
import pytest

from rainloom.llm import toxicity
from rainloom.llm.queries import QUERIES
from tests_llm_data import AWKWARD

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_rows(spark, tables):
    docs, labels = tables
    rows = QUERIES["op13_nnpu_toxicity"](spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    q = toxicity.quality(rows, labels).first()
    assert q["found"] >= 0.7 * q["n_toxic"] and q["accused"] <= 0.03 * (q["n"] - q["n_toxic"])


def test_held_out_labels_and_other_columns_change_nothing(spark, tables):
    docs, labels = tables
    scores = lambda d, x: sorted((r["doc_id"], r["score"]) for r in toxicity.score(d, x).collect())
    flipped = labels.selectExpr("doc_id", "1 - quality AS quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert scores(docs, labels) == scores(docs.selectExpr("doc_id", "text", "source AS lang", "lang AS source", "0 AS score", "1 AS predicted", "true AS pos"), flipped)


def test_risk():
    """The steps follow the estimator: the risk falls, and the part of the negatives never goes far below zero."""
    rng = np.random.default_rng(7)
    truth = rng.random(3000) < 0.2
    rows = [np.flatnonzero(rng.random(8) < (0.5 if t else 0.05)) for t in truth]
    pos = ((rng.random(3000) < 0.3) & truth).astype(float)
    unl = np.ones(3000)

    def risk(w):
        margin = np.array([w[r].sum() + w[-1] for r in rows])
        p, u = pos / pos.sum(), unl / unl.sum()
        return 0.2 * p @ np.logaddexp(0, -margin) + max(0.0, u @ np.logaddexp(0, margin) - 0.2 * p @ np.logaddexp(0, margin))

    short, long = (toxicity.fit(rows, pos, unl, 8, 0.2, steps) for steps in (1, 400))
    assert risk(long) < risk(short) < risk(np.zeros(9))
    score = np.array([long[r].sum() + long[-1] for r in rows])
    assert np.mean((score > 0) == truth) > 0.9
    assert abs((1 / (1 + np.exp(-score))).mean() - 0.2) < 0.05  # the mean chance is the prior


def test_features():
    assert toxicity.features("Scum, scum!") == {"scum$", "scum", "scum+"}
    assert toxicity.features("") == toxicity.features("12 _ --") == set()
    assert {"word$", "elev$", "elev"} <= toxicity.features("word éé elev")


def test_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(d, 1, int(d in (5, 8))) for d, _ in AWKWARD if d is not None] + [(None, None, 1), (5, 0, None), (8, None, 0)], LABELS)
    got = toxicity.score(awkward, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in AWKWARD)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    nothing = labels.limit(0)
    for d, x in ((awkward, nothing), (empty, labels), (empty, nothing)):
        rows = toxicity.score(d, x).collect()
        assert len(rows) == d.count()
    scores = {r["score"] for r in toxicity.score(awkward, nothing).collect()}
    assert len(scores) == 1 and abs(scores.pop() - toxicity.PRIOR) < 1e-9


def test_repeated_rows_are_one_example(spark):
    rows = [(0, "foul word here")] * 500 + [(k, f"fine text {k}") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k == 0)) for k in range(60)], LABELS)
    examples, prior = toxicity.sample(docs, labels)
    known = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert 0 in known and prior == 1 / len(known)
    assert examples.where("pos").count() == 1
