"""The transition classifier: training, scoring and its metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.vectors import as_doubles, cosine_score
from arcloom.operators.features import pair_features
from arcloom.operators.positions import running_total
from arcloom.sources.workspace import store

HIDDEN = [256, 128, 64]
EPOCHS, PATIENCE = 50, 5
#: Pairs of a partition: every partition answers each optimiser step with a gradient as large as the network.
PART_ROWS = 2048


def bce(label: Column, score: Column) -> Column:
    """Binary cross-entropy of one row, logarithms clamped at -100."""
    def log(p):
        return F.when(p > 0, F.greatest(F.log(p), F.lit(-100.0))).otherwise(-100.0)

    return -(label * log(score) + (1 - label) * log(1 - score))


def model_scores(model, rows: DataFrame) -> DataFrame:
    """Rows with ``features`` scored by the model in column ``score``."""
    vectors = rows.withColumn("_x", array_to_vector("features"))
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop(
        "_x", "_z", "rawPrediction", "probability", "prediction")


def train_transition_model(pairs: DataFrame, epochs: int = EPOCHS, patience: int = PATIENCE, hidden=None,
                           steps: int = 1, seed: int = 42):
    """Multilayer perceptron on standardised features, with early stopping on the validation loss.

    ``pairs`` carries ``features``, ``label`` and ``split``. Each epoch continues from the previous
    weights for ``steps`` optimiser steps; the best weights win. Without validation rows the training loss decides.
    The number of partitions follows the number of pairs and the cores, not the files they come from, and with it what the driver receives.
    Returns ``(model, history)`` with ``epoch, train_loss, val_loss, val_auc, val_acc``.
    """
    raw = pairs.select(array_to_vector("features").alias("_x"), F.col("label").cast("double").alias("label"), "split")
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(raw.filter("split = 'train'"))
    parts = min(math.ceil(max(raw.count(), 1) / PART_ROWS), 2 * pairs.sparkSession.sparkContext.defaultParallelism)
    rows = scaler.transform(raw).select("_z", "label", "split").coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    judges = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability")
    has_val = not val.isEmpty()
    layers = [rows.first()["_z"].size, *(HIDDEN if hidden is None else hidden), 2]
    best, weights, history, waited = None, None, [], 0

    def measure(model, part):
        scored = model.transform(part).withColumn("score", vector_to_array("probability")[1])
        loss, right = scored.agg(F.avg(bce(F.col("label"), F.col("score"))), F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        return float(loss), float(judges.evaluate(scored)), float(right)

    try:
        for epoch in range(1, epochs + 1):
            learner = MultilayerPerceptronClassifier(
                featuresCol="_z", labelCol="label", layers=layers, maxIter=steps, seed=seed, blockSize=128)
            if weights is not None:
                learner = learner.setInitialWeights(weights)
            model = learner.fit(train)
            weights = model.weights
            train_loss = measure(model, train)[0]
            val_loss, val_auc, val_acc = measure(model, val) if has_val else (None, None, None)
            history.append((epoch, train_loss, val_loss, val_auc, val_acc))
            loss = val_loss if has_val else train_loss
            if best is None or loss < best[0]:
                best, waited = (loss, model), 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        rows.unpersist()
    frame = pairs.sparkSession.createDataFrame(history, "epoch int, train_loss double, val_loss double, val_auc double, val_acc double")
    return PipelineModel(stages=[scaler, best[1]]), frame


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch with the least validation loss, the earlier one on ties."""
    return history.agg(F.min(F.struct("val_loss", "epoch")).alias("b")).select("b.epoch", "b.val_loss")


def cosine_scorer(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    def side(tag):
        return songs.select(F.col("id").alias(tag), as_doubles("embedding").alias(f"_{tag}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn(
        "score", cosine_score(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def score_transition(pairs: DataFrame, songs: DataFrame, scorer: Callable | PipelineModel | None = None) -> DataFrame:
    """Pairs ``(a, b)`` with ``score``: the model's probability, or the cosine without a model."""
    if scorer is None:
        return cosine_scorer(pairs, songs)
    return model_scores(scorer, pair_features(pairs, songs)).drop("features")


def classifier_metrics(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; a zero denominator gives 0."""
    yes, said = F.col("label") == 1, F.col("score") > threshold
    counts = preds.agg(
        F.count_if(~yes & ~said).alias("tn"), F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"), F.count_if(yes & said).alias("tp"))

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(preds: DataFrame) -> DataFrame:
    """Area under the ROC curve from rank sums, ties counted half.

    Rows are first reduced to distinct scores; the running count is cut into even slices.
    """
    by_score = store(preds.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")), "scores")
    ranked = running_total(by_score, "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.when(pairs > 0, won / pairs).alias("auc"))


def bce_loss(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg(bce(F.col("label"), F.col("score"))).alias("bce"))


def transition_band(score: Column) -> Column:
    """Share in percent as a word; a missing score stays missing."""
    pct = F.round(score * 100)
    return F.when(pct >= 70, "high").when(pct >= 50, "mid").when(pct.isNotNull(), "low")
