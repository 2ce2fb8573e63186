"""Toxicity scores by non-negative learning from positive and unlabelled texts.

Only confirmed toxic rows are used as examples; everything else is unlabelled, toxic texts included. The
risk of a classifier is estimated from both with the share of toxic texts (the class prior): what the
positives cost as positives, and what the unlabelled cost as negatives less the part of it that is due
to the toxic ones among them. That difference can't be negative, so where it becomes so the step goes
back up (the non-negative estimator). Several linear classifiers are trained, each without one fold of the
sample, in a Spark task each; the score is the logistic function of their mean.

The features of a text are its distinct lower-case words, the starts of words, and the starts that occur again. Those that are more
frequent in toxic texts than in unlabelled ones are found by counting them in Spark over the sample. Only
the text is read for a score; labels of rows that are held out (check sum of the id modulo 3 is 1) are
never read, nor are their texts.

Bounds: ``positives`` and ``unlabelled`` documents (about; by a threshold on a hash, so the choice is the
same on every run), at most FEATURES features. Every row is scored, over its whole text. Null and empty
texts have no features and get the score of the intercept. Repeated rows count once in the sample and get
equal scores. Rows without an id are not held out and can only be unlabelled examples. An id with
different labels is toxic if one of them says so. Without any toxic example every score is the prior.
Very long texts are scored like others; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import map_texts, materialize

HELD_OUT = 1  # of three
THRESHOLD = 0.7
POSITIVES, UNLABELLED = 10_000, 20_000
FEATURES = 1 << 15
STARTS = (4, 5, 6)  # letters of the starts of words
REPEATED = 5  # letters of those that are also looked for twice
EXCESS = 3.0  # deviations by which a feature is more frequent in toxic texts
FOLDS = 3
PRIOR = 0.1  # where no label tells
DECAY, STEPS, RATE = 1e-4, 400, 0.1
_WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def features(text: str) -> set[str]:
    """Distinct words, each with an end mark, their starts, and the starts that more than one word has."""
    found = _WORDS.findall(text.lower())
    words = set(found)
    out = {w + "$" for w in words}
    out.update([s + "+" for s, n in Counter([w[:REPEATED] for w in found]).items() if n > 1])
    for n in STARTS:
        out.update([w[:n] for w in words])
    return out


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """(text, pos, unl) of the examples, and the share of toxic rows among those with a label."""
    known = labels.where(~held_out()).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    n_docs = docs.where(~held_out("doc_id")).count()
    near = lambda cols, share: F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))
    # about ``positives`` ids by the hash of the id
    chosen = known.where("toxic = 1").where(near(["doc_id"], positives / max(n_toxic or 0, 1))).select(F.col("doc_id").alias("_id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.withColumns({"pos": F.col("_id").isNotNull(), "unl": near(["doc_id", "text"], unlabelled / max(n_docs, 1))}).where("pos OR unl")
    once = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    return materialize(once.select("text", "pos", "unl"), "examples"), (n_toxic / n if n else PRIOR)


def feature_counts(examples: DataFrame) -> DataFrame:
    """feature, pos, unl: texts of each kind that have it; counted in each slice first."""

    def run(batch):
        counts: dict[str, list[int]] = {}
        for text, pos, unl in zip(*(batch.column(c).to_pylist() for c in ("text", "pos", "unl"))):
            for f in features(text):
                own = counts.setdefault(f, [0, 0])
                own[0] += pos
                own[1] += unl
        return {"feature": list(counts), "pos": [c[0] for c in counts.values()], "unl": [c[1] for c in counts.values()]}

    part = map_texts(examples, run, "feature string, pos long, unl long")
    return part.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


def choose(counts: DataFrame, n_pos: int, n_unl: int, most: int = FEATURES) -> list[str]:
    """The features with the clearest excess in toxic texts, ``most`` at most."""
    expected = (F.col("unl") + 1) * (n_pos / max(n_unl, 1))
    excess = (F.col("pos") - expected) / F.sqrt(expected + 1)
    best = counts.withColumn("excess", excess).where(F.col("excess") >= EXCESS).orderBy(F.desc("excess"), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()]


def fit(rows: list[np.ndarray], pos: np.ndarray, unl: np.ndarray, n_features: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the features and the intercept, by full-batch descent on the non-negative risk.

    ``rows`` holds the features of each example; an example may be positive, unlabelled or both.
    """
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    p, u = pos / max(pos.sum(), 1), unl / max(unl.sum(), 1)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = np.bincount(row, w[column], len(rows)) + w[-1]
        chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        as_negative = np.logaddexp(0, margin)
        excess = u @ as_negative - prior * (p @ as_negative)
        slope = (u - prior * p) * chance  # of the unlabelled as negatives, less the toxic ones among them
        slope = prior * p * (chance - 1) + slope if excess >= 0 else -slope
        grad = np.r_[np.bincount(column, slope[row], n_features), slope.sum()]
        grad[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # nothing that a long text also says makes it less toxic
    return w


class Model:
    """Feature weights and intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        found = features(text) & self.weights.keys()
        total = self.intercept + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-total)))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, folds: int = FOLDS) -> Model:
    """A model from confirmed toxic rows and unlabelled texts; ``prior`` defaults to the share among the labelled rows."""
    examples, share = sample(docs, labels, positives, unlabelled)
    prior = min(max(share if prior is None else prior, 1e-3), 1 - 1e-3)
    n_pos, n_unl = examples.agg(F.count_if("pos"), F.count_if("unl")).first()
    chosen = choose(feature_counts(examples), n_pos, n_unl) if n_pos else []
    if not chosen:
        return Model({}, float(np.log(prior / (1 - prior))))
    number = {f: k for k, f in enumerate(chosen)}
    n = len(number)

    def known(batch):
        texts = batch.column("text").to_pylist()
        own = [sorted(number[f] for f in features(t) & number.keys()) for t in texts]
        return {"text": texts, "pos": batch.column("pos"), "unl": batch.column("unl"), "own": own}

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        w = fit([np.asarray(r) for r in rows["own"]], rows["pos"].to_numpy(float), rows["unl"].to_numpy(float), n, prior)
        return pd.DataFrame({"feature": np.arange(n + 1), "weight": w})

    coded = map_texts(examples, known, "text string, pos boolean, unl boolean, own array<int>")
    coded = coded.select("pos", "unl", "own", F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"))
    spread = coded.withColumn("model", F.explode(F.filter(F.array(*[F.lit(k) for k in range(max(folds, 2))]), lambda k: k != F.col("fold"))))
    fitted = spread.groupBy("model").applyInPandas(learn, "feature int, weight double")
    # FEATURES + 1 rows at most
    mean = {r["feature"]: r["w"] for r in fitted.groupBy("feature").agg(F.avg("weight").alias("w")).collect()}
    return Model({f: mean[k] for f, k in number.items()}, mean[n])


def apply(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"))

    def run(batch):
        scores = [model.score(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_texts(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model trained on the rows that are not held out."""
    return apply(docs, train(docs, labels, **options))


def quality(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the held-out rows with a label: how many, how many toxic, found, and wrongly accused."""
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = scored.where("held_out").join(truth, "doc_id")
    return both.agg(
        F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"), F.count_if(F.expr("toxic = 1 AND predicted = 1")).alias("found"),
        F.count_if(F.expr("toxic = 0 AND predicted = 1")).alias("accused"),
    )
