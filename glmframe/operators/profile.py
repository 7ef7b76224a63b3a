"""Profiles of a FeatureFrame: label counts, shape, constant features, scaling.

Every profile is one aggregate pass (partial aggregation in each task, a
final merge of one row per task or per label value), so the shuffle is tiny
whatever the row count. The only results that reach the driver are
feature-sized (one value per feature), never row-sized.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glmframe.frame import LABEL, PACKED, FeatureFrame, fcol

log = logging.getLogger(__name__)

POSITIVE = 1.0


# ------------------------------------------------------------- label counts
def label_distribution(frame: FeatureFrame) -> DataFrame:
    """``(label, n)``: number of rows per distinct label value."""
    return frame.df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


def positive_rate(frame: FeatureFrame) -> DataFrame:
    """One row ``(positives, total, percent)`` for label 1.0.

    With no positive row this is 0 and 0.0 (never an error).
    """
    agg = frame.df.agg(
        F.count_if(F.col(LABEL) == F.lit(POSITIVE)).alias("positives"), F.count(F.lit(1)).alias("total")
    )
    pct = F.when(F.col("total") > 0, F.col("positives") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0))
    return agg.select("positives", "total", pct.alias("percent"))


def matrix_shape(frame: FeatureFrame) -> DataFrame:
    """One row ``(rows, features)``."""
    return frame.df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(frame.width).alias("features"))


# -------------------------------------------------------- constant features
def _constant_stats(frame: FeatureFrame) -> list[Column]:
    stats = [F.count(F.lit(1)).alias("_rows")]
    for c in frame.feature_cols:
        stats += [
            F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"),
            F.count_if(F.isnan(c)).alias(f"{c}__nan"),
        ]
    return stats


def _is_constant(c: str) -> Column:
    """Constant = every value equal under IEEE equality (NaN equals nothing).

    ``min = max`` treats NaN as equal to NaN, so a column holding a NaN and
    at least two rows is *not* constant. One row is always constant; -0.0
    equals 0.0.
    """
    varies = (F.col(f"{c}__min") != F.col(f"{c}__max")) | (
        (F.col(f"{c}__nan") > 0) & (F.col("_rows") >= 2)
    )
    return ~F.coalesce(varies, F.lit(False))


def _by_position(frame: FeatureFrame, *aggs: Column) -> DataFrame:
    """Aggregates of a packed frame's features: one row per position, combined map-side.

    Column ``x`` is the feature, so NULL and NaN count exactly as in the
    aggregates of the wide layout's columns.
    """
    exploded = frame.df.select(F.posexplode(PACKED).alias("position", "x"))
    return exploded.groupBy("position").agg(F.count(F.lit(1)).alias("_rows"), *aggs)


def _packed_flags(frame: FeatureFrame) -> DataFrame:
    stats = _by_position(
        frame, F.min("x").alias("x__min"), F.max("x").alias("x__max"), F.count_if(F.isnan("x")).alias("x__nan")
    )
    names = frame.df.sparkSession.createDataFrame(
        list(enumerate(frame.feature_names)), "position INT, name STRING"
    )
    # no rows: every feature counts as constant
    flag = F.coalesce(_is_constant("x"), F.lit(True))
    return names.join(stats, "position", "left").select("position", "name", flag.alias("is_constant"))


def constant_feature_flags(frame: FeatureFrame) -> DataFrame:
    """``(position, name, is_constant)`` per feature, from one aggregate pass."""
    if frame.packed:
        return _packed_flags(frame)
    stats = frame.df.agg(*_constant_stats(frame))
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), _is_constant(fcol(i)).alias("is_constant"))
        for i, n in enumerate(frame.feature_names)
    ]
    if not entries:
        return stats.select(F.inline(F.array().cast("array<struct<position:int,name:string,is_constant:boolean>>")))
    return stats.select(F.inline(F.array(*entries)))


def drop_constant_features(frame: FeatureFrame) -> FeatureFrame:
    """Keep only features with at least two distinct values (one job).

    On an empty input nothing is dropped (with a warning).
    """
    if frame.width == 0:
        return frame
    if not frame.df.select(F.lit(1)).take(1):
        log.warning("drop_constant_features on an empty frame: nothing dropped")
        return frame
    # one flag per feature: model-sized
    flags = constant_feature_flags(frame).collect()
    return frame.project_by_index(sorted(r["position"] for r in flags if not r["is_constant"]))


# ------------------------------------------------------------------ moments
def column_moments(frame: FeatureFrame) -> list[tuple[float | None, float | None]]:
    """Per feature: (mean, sample standard deviation), one pass."""
    if frame.packed:
        rows = _by_position(frame, F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).collect()
        found = {r["position"]: (r["mean"], r["std"]) for r in rows}
        return [found.get(i, (None, None)) for i in range(frame.width)]
    aggs = []
    for c in frame.feature_cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    if not aggs:
        return []
    row = frame.df.agg(*aggs).first()
    return [(row[f"{c}__mean"], row[f"{c}__std"]) for c in frame.feature_cols]


# --------------------------------------------------------- observed counters
def observe_counters(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Attach named aggregate counters to a plan; read them after an action.

    The counters are computed inside the same job as the action (no extra
    pass); ``Observation.get`` blocks until the action has run.
    """
    obs = Observation(name)
    exprs = [c.alias(k) for k, c in counters.items()]
    return df.observe(obs, *exprs), obs
