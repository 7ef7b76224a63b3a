"""Scoring a FeatureFrame with a LinearModel, and checking the predictions.

Scoring is a single projection: the model weights are literals in an
arithmetic expression (no ML UDF), so it fuses with the scan into one
whole-stage-codegen stage, needs no shuffle and works on streaming frames.
On a packed frame the margin is a fold
over the feature array against one weight-array literal instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.frame import LABEL, FeatureFrame, qcol
from glmframe.functions.numeric import linear_margin, logistic, packed_margin, threshold_class
from glmframe.sources.model_store import LinearModel

ALIGN_MODES = ("name", "position")
THRESHOLD = 0.5


def missing_features(frame: FeatureFrame, model: LinearModel) -> list[str]:
    """Model feature names that the frame does not have (in model order)."""
    have = set(frame.feature_names)
    return [n for n in model.names if n not in have]


def align(frame: FeatureFrame, model: LinearModel, mode: str = "name") -> FeatureFrame:
    """Arrange the frame's features in the model's order.

    ``name``: select by the model's names (error listing the missing ones).
    ``position``: use the frame as it is; the widths must agree.
    """
    if mode not in ALIGN_MODES:
        raise ValueError(f"align must be one of {ALIGN_MODES}, got {mode!r}")
    if mode == "position":
        if frame.width != len(model.weights):
            raise ValueError(f"frame has {frame.width} features, model has {len(model.weights)}")
        return frame
    missing = missing_features(frame, model)
    if missing:
        raise KeyError(f"features of the model missing from the data: {missing}")
    return frame.project(list(model.names))


def score(frame: FeatureFrame, model: LinearModel, align_mode: str = "name", threshold: float = THRESHOLD) -> DataFrame:
    """``carry…, label, margin, probability, prediction``.

    Logistic models: probability = logistic(margin), prediction = 1.0 when
    probability > threshold else 0.0. Linear models: probability is NULL
    and prediction = margin. A row with a missing feature has no prediction.
    """
    aligned = align(frame, model, align_mode)
    if aligned.packed:
        margin = packed_margin(aligned.feature_array(), model.weights, model.intercept)
    else:
        margin = linear_margin(aligned.feature_cols, model.weights, model.intercept)
    scored = aligned.df.select(*[qcol(c) for c in aligned.carry], F.col(LABEL), margin.alias("margin"))
    if model.kind == "linear":
        return scored.select("*", F.lit(None).cast("double").alias("probability"), F.col("margin").alias("prediction"))
    prob = logistic(F.col("margin"))
    return scored.select("*", prob.alias("probability")).select(
        "*", threshold_class(F.col("probability"), threshold).alias("prediction")
    )


def confusion_counts(scored: DataFrame) -> DataFrame:
    """``(label, prediction, n)``: one partial+final aggregate."""
    return scored.groupBy(LABEL, "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row ``(rows, correct, unscored, accuracy)``: ``rows`` have a prediction,
    ``unscored`` ones don't; accuracy is over the former (NULL on no rows)."""
    agg = scored.agg(
        F.count("prediction").alias("rows"), F.count_if(F.col("prediction").isNull()).alias("unscored"), F.count_if(F.col(LABEL) == F.col("prediction")).alias("correct")
    )
    acc = F.when(F.col("rows") > 0, F.col("correct") / F.col("rows"))
    return agg.select("rows", "correct", "unscored", acc.alias("accuracy"))


def keyed_predictions(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions carried with a row key instead of a bare index."""
    return scored.select(*[qcol(k) for k in keys], "prediction")
