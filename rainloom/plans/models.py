"""Statistical models of the environment response, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom import constants as C
from rainloom.functions.ranking import exact_percentiles
from rainloom.plans.boosting import Boosted
from rainloom.session import discard, materialize


def prepare_predictors(df: DataFrame, response: str | None, predictors=C.PREDICTORS, cin: str = C.CIN_COL) -> DataFrame:
    """Missing inhibition means none (0); rows lacking any other predictor or the response go."""
    if cin in df.columns:
        df = df.withColumn(cin, F.coalesce(cin, F.lit(0.0)))
    return df.dropna(subset=[*predictors, *([response] if response else [])])


def _stored(df: DataFrame, *columns: str) -> DataFrame:
    """The columns a fit needs, written once: a fit passes over its rows many times, and what derives them (joins) would run each time."""
    return materialize(df.select(*dict.fromkeys(columns)), "model")


def standardise(df: DataFrame, predictors=C.PREDICTORS) -> DataFrame:
    """Add ``features`` (vector of z-scores, sample standard deviation)."""
    steps = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(predictors), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        ]
    )
    return steps.fit(df).transform(df)


def fit_ols(df: DataFrame, response: str, predictors=C.PREDICTORS) -> DataFrame:
    """Coefficients of the least-squares fit on standardised predictors."""
    rows = _stored(prepare_predictors(df, response, predictors), response, *predictors)
    z = standardise(rows, predictors)
    model = LinearRegression(featuresCol="features", labelCol=response, solver="normal", standardization=False).fit(z)
    discard(rows)
    terms = [(p, float(b)) for p, b in zip(predictors, model.coefficients)] + [("const", float(model.intercept))]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def _assembled(df: DataFrame, predictors) -> DataFrame:
    return VectorAssembler(inputCols=list(predictors), outputCol="features").transform(df)


def hash_split(df: DataFrame, test: float, key: str = "feature_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train / test by a hash of the key: the same rows on any cluster layout."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    cut = int(test * 10_000)
    return df.where(bucket >= cut), df.where(bucket < cut)


def fit_gbt(
    df: DataFrame, response: str, predictors=C.PREDICTORS, rounds: int = 20, depth: int = 5, test: float = 0.25
) -> tuple[Model, DataFrame]:
    """Boosted-tree regression: the model, and importances with the held-out R2."""
    stored = _stored(prepare_predictors(df, response, predictors), "feature_id", response, *predictors)
    train, held = hash_split(_assembled(stored, predictors), test)
    model = GBTRegressor(featuresCol="features", labelCol=response, maxIter=rounds, maxDepth=depth, seed=0).fit(train)
    r2 = RegressionEvaluator(labelCol=response, metricName="r2").evaluate(model.transform(held))
    discard(stored)
    rows = [(p, float(w), float(r2)) for p, w in zip(predictors, model.featureImportances.toArray())]
    return model, df.sparkSession.createDataFrame(rows, "predictor string, importance double, test_r2 double")


def held_out(df: DataFrame, response: str, predictors=C.PREDICTORS, test: float = 0.25) -> DataFrame:
    """The rows on which ``fit_gbt`` with the same ``test`` has not been fitted."""
    return hash_split(prepare_predictors(df, response, predictors), test)[1]


def ale(model: Model | Boosted, df: DataFrame, feature: str, predictors=C.PREDICTORS, bins: int = 20) -> DataFrame:
    """Accumulated local effect of one predictor over quantile bins.

    Each row is scored at both edges of its bin; the mean differences are added up along the
    bins and centred on their weighted mean. ``df`` should be rows of the population the model was
    fitted on, best those held out (``held_out``).
    """
    data = _stored(prepare_predictors(df, None, predictors), *predictors)
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edge_row = exact_percentiles(data.withColumn("_all", F.lit(1)), ("_all",), feature, probs).first()
    # bins + 1 numbers
    edges = sorted({edge_row[f"e{i}"] for i in range(bins + 1)})
    lows, highs = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    # right-closed bins; the smallest value joins the first one
    b = F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(feature))) - 1, F.lit(0))
    binned = data.withColumn("_bin", b).withColumns({"_lo": F.get(lows, F.col("_bin")), "_hi": F.get(highs, F.col("_bin"))})
    scored = binned
    for side in ("lo", "hi"):
        moved = [f"_{side}" if p == feature else p for p in predictors]
        if isinstance(model, Boosted):
            scored = scored.withColumn(f"_y_{side}", model.predict({p: F.col(c) for p, c in zip(predictors, moved)}))
            continue
        scored = VectorAssembler(inputCols=moved, outputCol=f"_x_{side}").transform(scored)
        scored = model.copy({model.featuresCol: f"_x_{side}", model.predictionCol: f"_y_{side}"}).transform(scored)
    effect = scored.groupBy("_bin", "_lo", "_hi").agg(F.avg(F.col("_y_hi") - F.col("_y_lo")).alias("local"), F.count("*").alias("n"))
    # at most ``bins`` rows from here on
    one = Window.partitionBy(F.lit(1))
    run = one.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    acc = effect.withColumn("acc", F.sum("local").over(run))
    mid = F.col("acc") - F.col("local") / 2.0
    centre = F.sum(mid * F.col("n")).over(one) / F.sum("n").over(one)
    return acc.select(
        F.col("_bin").alias("bin"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "n", "local", (F.col("acc") - centre).alias("effect")
    )


def partial_effect(
    df: DataFrame, y: str, t: str, controls: list[str], folds: int = 2, key: str = "feature_id", nuisance: str = "gbt", rounds: int = 10, depth: int = 4
) -> DataFrame:
    """Debiased average effect of ``t`` on ``y``: residual on residual, nuisances cross-fitted."""
    data = prepare_predictors(df, y, [t, *controls]).withColumn(
        "_fold", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds))
    )
    data = _assembled(_stored(data, y, t, *controls, "_fold"), controls)
    parts = []
    for k in range(folds):
        train, held = data.where(F.col("_fold") != k), data.where(F.col("_fold") == k)
        for target, out in ((y, "_y_hat"), (t, "_t_hat")):
            if nuisance == "gbt":
                learner = GBTRegressor(featuresCol="features", labelCol=target, predictionCol=out, maxIter=rounds, maxDepth=depth, seed=0)
            else:
                learner = LinearRegression(featuresCol="features", labelCol=target, predictionCol=out)
            held = learner.fit(train).transform(held)
        parts.append(held.select((F.col(y) - F.col("_y_hat")).alias("ry"), (F.col(t) - F.col("_t_hat")).alias("rt")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    m = res.agg(
        F.sum(F.col("rt") * F.col("ry")).alias("ty"),
        F.sum(F.col("rt") * F.col("rt")).alias("tt"),
        F.sum(F.col("ry") * F.col("ry")).alias("yy"),
        F.count("*").alias("n"),
    )
    effect = F.try_divide("ty", "tt")
    spread = F.sqrt(F.greatest((F.col("yy") - effect * F.col("ty")) / F.greatest(F.col("n") - 1, F.lit(1)) / F.col("tt"), F.lit(0.0)))
    return m.select(effect.alias("effect"), spread.alias("std_error"), "n")


def fit_extreme_classifier(
    labelled: DataFrame, label: str = "ext_pct", predictors=C.PREDICTORS, rounds: int = 20, depth: int = 4, test: float = 0.25
) -> DataFrame:
    """Boosted-tree classifier with balanced class weights: held-out PR-AUC, prevalence, importances."""
    stored = _stored(prepare_predictors(labelled, label, predictors), "feature_id", label, *predictors)
    train, held = hash_split(_assembled(stored, predictors).withColumn("label", F.col(label).cast("double")), test)
    freq = train.groupBy("label").agg(F.count("*").alias("_k")).withColumn(
        "weight", F.sum("_k").over(Window.partitionBy(F.lit(1))) / (2.0 * F.col("_k"))
    )
    weighted = train.join(F.broadcast(freq.drop("_k")), "label")
    model = GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, seed=0).fit(weighted)
    scored = model.transform(held)
    auc = BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(scored)
    base = held.agg(F.avg("label")).first()[0]
    discard(stored)
    rows = [(p, float(w), float(auc), float(base)) for p, w in zip(predictors, model.featureImportances.toArray())]
    return labelled.sparkSession.createDataFrame(
        rows, "predictor string, importance double, pr_auc double, prevalence double"
    )


def extreme_probability(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p_extreme", F.get(vector_to_array("probability"), F.lit(1)))
