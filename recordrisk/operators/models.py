"""Classifiers on Spark ML, with the reference parameters as defaults."""

import math
from contextlib import contextmanager
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.operators.evaluate import confusion_counts
from recordrisk.operators.features import fit_scaling
from recordrisk.operators.forest import joined, with_least_split
from recordrisk.operators.resample import SEED, balanced_weights, stratified_folds
from recordrisk.schemas import FEATURES, METRIC, TARGET
from recordrisk.workspace import concurrently, durable, scratch


# Trees are grown over partitions of about this many rows, whatever the files hold, and as many at a time as
# keep what Spark stores of the rows (a count per tree and row) near this size.
TASK_ROWS = 250_000
STORED_BYTES = 2 << 30
LEAST_TREES = 25
_ROW_BYTES = 150


@contextmanager
def _spread(df, features, label, weight=None):
    """The columns a fit reads, and the number of rows: many rows lie in even partitions, kept until the end."""
    data = with_filled(df, features).select(*[f"{c}_filled" for c in features], F.col(label).cast("double").alias(label), *([weight] if weight else []))
    n = data.count()
    if n <= TASK_ROWS:
        yield data, n
        return
    data = data.repartition(max(-(-n // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)).persist()
    try:
        yield data, n
    finally:
        data.unpersist()


def _fit(data, stage, features, label, weight):
    """Assembler and estimator as one saved unit; missing features count as zero."""
    assembler = VectorAssembler(inputCols=[f"{c}_filled" for c in features], outputCol="features")
    if weight:
        stage = stage.setWeightCol(weight)
    return Pipeline(stages=[assembler, stage.setLabelCol(label).setFeaturesCol("features")]).fit(data)


def with_filled(df: DataFrame, features) -> DataFrame:
    return df.withColumns({f"{c}_filled": C.zero_filled(c) for c in features})


def train_random_forest(df: DataFrame, features=FEATURES, label=TARGET, trees=200, depth=12, min_leaf=2,
                        balanced=True, seed=SEED, min_split=5) -> PipelineModel:
    """Random forest with balanced weights; binary or multi-class. Nodes of fewer than ``min_split`` rows aren't split.

    Over many rows the trees are grown some at a time, each lot with draws of its own, and joined to one forest.
    """
    if balanced:
        df = balanced_weights(df, label, "_weight")
    weight = "_weight" if balanced else None
    with _spread(df, features, label, weight) as (data, n):
        at_once = max(LEAST_TREES, (STORED_BYTES // max(n, 1) - _ROW_BYTES) // 4)
        parts = [
            _fit(data, RandomForestClassifier(numTrees=min(at_once, trees - first), maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed + first), features, label, weight)
            for first in range(0, trees, at_once)]
    model = joined(parts) if len(parts) > 1 else parts[0]
    return with_least_split(model, min_split) if min_split > 2 * min_leaf else model


def train_boosted_trees(df: DataFrame, features=FEATURES, label=TARGET, rounds=200, depth=8, rate=0.05,
                        row_sample=0.8, feature_sample=0.8, weight=None, seed=SEED) -> PipelineModel:
    """Gradient-boosted trees for a 0/1 label; features are sampled per node."""
    with _spread(df, features, label, weight) as (data, _):
        return _fit(data, _boosted(rounds, depth, rate, row_sample, feature_sample, seed), features, label, weight)


def _boosted(rounds, depth, rate, row_sample, feature_sample, seed):
    strategy = "all" if feature_sample >= 1 else str(feature_sample)
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=row_sample,
                         featureSubsetStrategy=strategy, seed=seed)


def train_boosted_multiclass(df: DataFrame, features=FEATURES, label=TARGET, rounds=200, depth=6, rate=0.1,
                             seed=SEED) -> PipelineModel:
    """Boosted trees for several classes, one against the rest, with balanced weights."""
    df = balanced_weights(df, label, "_weight")
    stage = OneVsRest(classifier=_boosted(rounds, depth, rate, 1.0, 1.0, seed))
    with _spread(df, features, label, "_weight") as (data, _):
        return _fit(data, stage, features, label, "_weight")


def train_logistic(df: DataFrame, features=FEATURES, label=TARGET, max_iter=1000, inverse_penalty=1.0) -> PipelineModel:
    """Logistic regression with balanced weights on scaled features and an L2 penalty.

    Scaling is by mean and population deviation of the training rows and is folded into the
    saved model's feature columns, so predicting needs no second table.
    """
    df = balanced_weights(df, label, "_weight")
    filled = with_filled(df, features)
    n = filled.count()
    scaling = fit_scaling(filled, [f"{c}_filled" for c in features])
    stage = LogisticRegression(maxIter=max_iter, regParam=1.0 / (n * inverse_penalty), elasticNetParam=0.0,
                               standardization=False)
    return Pipeline(stages=[
        *_scaling_stages(features, scaling),
        stage.setLabelCol(label).setFeaturesCol("features").setWeightCol("_weight"),
    ]).fit(filled.withColumn(label, F.col(label).cast("double")))


def _scaling_stages(features, scaling):
    from pyspark.ml.feature import SQLTransformer

    scaled = ", ".join(
        f"(`{c}_filled` - ({scaling[f'{c}_filled'][0]!r}D)) / {scaling[f'{c}_filled'][1]!r}D AS `{c}_scaled`"
        for c in features)
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_scaled" for c in features], outputCol="features"),
    ]


def _inputs(model):
    """Feature names of a fitted model: its own (``BoostedModel``), or those of its assembler."""
    if hasattr(model, "features"):
        return list(model.features)
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.rsplit("_", 1)[0] for c in assembler.getInputCols()]


def predict(model: PipelineModel, df: DataFrame, keep=None) -> DataFrame:
    """Adds ``prediction`` (int), ``score`` (probability of class 1) and ``confidence``.

    Confidence is the probability of the predicted class. One-against-rest models have no
    probabilities; score and confidence are then NULL.
    """
    keep = list(keep or df.columns)
    out = model.transform(with_filled(df, _inputs(model)))
    chosen = F.col("prediction").cast("int")
    if "probability" in out.columns:
        p = vector_to_array("probability")
        score, confidence = p[1], F.element_at(p, chosen + 1)
    else:
        score = confidence = F.lit(None).cast("double")
    return out.select(*keep, chosen.alias("prediction"), score.alias("score"), confidence.alias("confidence"))


def feature_importance(model: PipelineModel) -> DataFrame:
    """Importance per feature, lowest first, marking those above the mean."""
    from pyspark.sql import SparkSession

    names = _inputs(model)
    values = model.importances if hasattr(model, "importances") else model.stages[-1].featureImportances.toArray()
    mean = float(values.mean())
    rows = [(n, float(v), int(v > mean)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(
        rows, "feature string, importance double, above_mean int").orderBy("importance", "feature")


def rule_classifier(df: DataFrame, col="Funding", threshold=R.RULE_THRESHOLD) -> DataFrame:
    """Safe above a funding threshold, with one fixed confidence."""
    return df.withColumns({
        "Prediction": C.outcome_label(F.when(F.col(col) > threshold, 1).otherwise(0)),
        "Confidence": F.lit(R.RULE_CONFIDENCE)})


def cross_validate_f1(df: DataFrame, key, train, k=5, features=FEATURES, label=TARGET, resample=None,
                      when="inside", seed=SEED, at_once=5) -> DataFrame:
    """F1 and rows per fold, then mean and population deviation of F1.

    ``train`` fits a model on a table; ``resample`` balances one. By default it is applied
    to the training folds only; ``when="before"`` resamples first and folds afterwards,
    which lets copies of a row fall on both sides. Up to ``at_once`` folds are trained at the same time, from one stored
    table of folds.
    """
    if resample and when == "before":
        df = resample(df).withColumn("_row", F.coalesce(F.col(key).cast("string"), F.concat_ws(":", label, "draw")))
        key = "_row"
    spark = df.sparkSession
    with scratch(spark):
        folds = durable(stratified_folds(df, key, label, k, seed))

        def tested(fold):
            with scratch(spark):
                seen = folds.where(F.col("fold") != fold)
                if resample and when == "inside":
                    seen = durable(resample(seen))
                answers = predict(train(seen), folds.where(F.col("fold") == fold))
                return confusion_counts(answers, label, "prediction").first()

        cells = concurrently(spark, [partial(tested, fold) for fold in range(k)], at_once)
    scores, rows = [], [float(sum(c)) for c in cells]
    for c in cells:
        hits, wrong = c["tp"], c["fp"] + c["fn"]
        scores.append(2 * hits / (2 * hits + wrong) if hits + wrong else 0.0)
    mean = sum(scores) / k
    deviation = math.sqrt(sum((s - mean) ** 2 for s in scores) / k)
    out = [("cv", f"fold_{i}", s) for i, s in enumerate(scores)] + [("cv", f"rows_{i}", n) for i, n in enumerate(rows)]
    return spark.createDataFrame(out + [("cv", "mean_f1", mean), ("cv", "std_f1", deviation)], METRIC)
