"""Boosted regression trees with exact splits, as rounds of aggregations.

A level of a tree looks at every predictor's values in order: sums of the residuals and of the weights up to
each value tell what a cut there gains, so every value that occurs is tried, and none is binned. The sums
run over range-partitioned slices (``running_sums``), so no node and no predictor is ever in one task. What
reaches the driver is a split per node, at most two to the power of the depth, and as many leaf values.

Residuals are those of the squared error. Rows carry ``train``: others take no part in the fit but get
predictions. Rows lacking a predictor are to be left out first (``models.prepare_predictors``). Ties go to
the predictor and then the value that comes last in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions.ranking import running_sums
from rainloom.session import discard, materialize


@dataclass
class Tree:
    """Splits (predictor, threshold; up to it goes left) by node, and values by leaf; the children of node k are 2k and 2k + 1."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    found: list[tuple] = field(default_factory=list)  # node, predictor, threshold, gain, weight

    def node(self, columns: dict[str, Column]) -> Column:
        def below(k: int) -> Column:
            if k not in self.splits:
                return F.lit(k)
            predictor, threshold = self.splits[k]
            return F.when(columns[predictor] <= F.lit(threshold), below(2 * k)).otherwise(below(2 * k + 1))

        return below(1)

    def value(self, columns: dict[str, Column]) -> Column:
        def below(k: int) -> Column:
            if k not in self.splits:
                return F.lit(self.leaves[k])
            predictor, threshold = self.splits[k]
            return F.when(columns[predictor] <= F.lit(threshold), below(2 * k)).otherwise(below(2 * k + 1))

        return below(1)


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]

    def predict(self, columns: dict[str, Column]) -> Column:
        """The prediction from the predictors' columns, some of which may be replaced by others."""
        out = F.lit(self.start)
        for t in self.trees:
            out = out + F.lit(self.rate) * t.value(columns)
        return out


def best_splits(rows: DataFrame, predictors) -> DataFrame:
    """node, predictor, threshold, gain and weight: the best cut of each node of ``rows`` (node, residual, weight, predictors)."""
    names = sorted(predictors)  # by number while rows are many; numbers keep the order of the names
    values = F.array(*[F.col(p).cast("double") for p in names])
    long = rows.select("node", (F.col("weight") * F.col("residual")).alias("s"), "weight", F.posexplode(values).alias("predictor", "value"))
    by_value = long.groupBy("node", "predictor", "value").agg(F.sum("s").alias("s"), F.sum("weight").alias("w"))
    run = running_sums(by_value, ("node", "predictor"), "value", ["s", "w"])
    left, right = F.col("s_upto") ** 2 / F.col("w_upto"), (F.col("s_total") - F.col("s_upto")) ** 2 / (F.col("w_total") - F.col("w_upto"))
    cut = run.where(F.col("last") == 0).withColumn("gain", left + right - F.col("s_total") ** 2 / F.col("w_total"))
    best = cut.groupBy("node").agg(F.max(F.struct("gain", "predictor", "value", "w_total")).alias("b"))
    return best.select("node", F.get(F.array(*map(F.lit, names)), F.col("b.predictor")).alias("predictor"), F.col("b.value").alias("threshold"), "b.gain", F.col("b.w_total").alias("weight"))


def grow(rows: DataFrame, predictors, depth: int) -> Tree:
    """A tree for the residuals of ``rows`` (residual, weight, predictors)."""
    tree, columns = Tree(), {p: F.col(p) for p in predictors}
    for level in range(depth):
        here = rows.withColumn("node", tree.node(columns)).where(F.col("node") >= 1 << level)
        for s in best_splits(here, predictors).collect():  # a node of this level each
            if s["gain"] > 0:
                tree.splits[s["node"]] = (s["predictor"], s["threshold"])
                tree.found.append((s["node"], s["predictor"], s["threshold"], s["gain"], s["weight"]))
    leaves = rows.groupBy(tree.node(columns).alias("node")).agg((F.sum(F.col("weight") * F.col("residual")) / F.sum("weight")).alias("value"))
    tree.leaves = {r["node"]: r["value"] for r in leaves.collect()}
    return tree


def fit_exact(df: DataFrame, response: str, predictors, rounds: int = 20, depth: int = 3, rate: float = 0.1, train: str = "train", weight: str | None = None) -> Boosted:
    """Boosted trees on the rows of ``df`` where ``train`` holds; ``weight`` names a column of weights."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    kept = df.where(train).select(F.col(response).cast("double").alias("y"), w.alias("weight"), *[F.col(p).cast("double").alias(p) for p in predictors])
    stored = materialize(kept, "boost")
    start = stored.agg(F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).first()[0]
    rows = stored.withColumn("residual", F.col("y") - F.lit(start)).drop("y")
    trees, columns = [], {p: F.col(p) for p in predictors}
    for k in range(rounds):
        trees.append(grow(rows, predictors, depth))
        if k + 1 < rounds:
            rows = materialize(rows.withColumn("residual", F.col("residual") - F.lit(rate) * trees[-1].value(columns)), "boost")
            discard(stored)
            stored = rows
    discard(stored)
    return Boosted(start, rate, trees)


def splits_of(model: Boosted, spark) -> DataFrame:
    """round, node, predictor, threshold, gain and weight of every split."""
    rows = [(r, *s) for r, t in enumerate(model.trees, 1) for s in t.found]
    return spark.createDataFrame(rows, "round int, node int, predictor string, threshold double, gain double, weight double")


def r2(df: DataFrame, response: str, prediction: Column) -> DataFrame:
    """Share of the variance of ``response`` that a prediction explains, in one pass over shifted sums."""
    y = F.col(response).cast("double")
    rest = F.sum((y - prediction) ** 2)
    return df.agg((1.0 - F.try_divide(rest, F.var_pop(y) * F.count(y))).alias("r2"), F.count(y).alias("n"))


def average_precision(df: DataFrame, label: str, score: Column) -> DataFrame:
    """Area under precision and recall as the sum over the distinct scores, the best first; and the share of positives."""
    by_score = df.select(F.col(label).cast("double").alias("l"), (-score).alias("value")).groupBy("value").agg(F.sum("l").alias("p"), F.count("*").cast("double").alias("c"))
    run = running_sums(by_score, (), "value", ["p", "c"])
    return run.agg(
        F.sum(F.col("p") / F.col("p_total") * F.col("p_upto") / F.col("c_upto")).alias("pr_auc"), (F.max("p_total") / F.max("c_total")).alias("prevalence"), F.max("c_total").cast("long").alias("n")
    )


def md5_split(df: DataFrame, key: str = "feature_id", parts: int = 4) -> DataFrame:
    """``train``: false for one part in ``parts`` by a digest of the key."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("train", F.pmod(number, F.lit(parts)) != 0)


def balanced(df: DataFrame, label: str, train: str = "train") -> DataFrame:
    """``weight``: both classes of the training rows weigh the same."""
    n, n1 = df.where(train).agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    one, zero = (n / (2.0 * k) if k else 1.0 for k in (n1 or 0, n - (n1 or 0)))
    return df.withColumn("weight", F.when(F.col(label).cast("int") == 1, F.lit(one)).otherwise(F.lit(zero)))
