"""The two end-to-end jobs: train a model from a matrix, score a matrix.

``train`` = scan -> persisted training input -> one combined profile pass
(shape + label counts) and the fit, both over the persisted copy -> model
file. ``predict`` = model file -> scan -> scoring projection ->
distributed row index -> prediction files. Both are compositions of the
operators; neither collects data rows to the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glmframe.frame import LABEL, FeatureFrame
from glmframe.operators.model_report import weight_ranking, zero_weight_summary
from glmframe.operators.profile import observe_counters
from glmframe.operators.row_index import with_input_order_index, with_row_index
from glmframe.operators.scaling import Scaler
from glmframe.operators.scoring import accuracy, score
from glmframe.operators.train import (
    DEFAULT_ITERATIONS,
    DEFAULT_REG_PARAM,
    fit_linear,
    fit_logistic_l1,
    training_input,
)
from glmframe.sources.csv_matrix import ORDER_COLS, read_matrix
from glmframe.sources.model_store import LinearModel, load_model
from glmframe.sources.predictions import write_predictions

log = logging.getLogger(__name__)

KINDS = ("logistic", "linear")
# row keys travel under this prefix, so that a key may have any name
KEY_PREFIX = "_key_"


@dataclass(frozen=True)
class TrainResult:
    model: LinearModel
    rows: int
    positives: int
    partitions: int = 0

    @property
    def model_width(self) -> int:
        return len(self.model.weights)

    @property
    def positive_percent(self) -> float:
        return self.positives * 100.0 / self.rows if self.rows else 0.0


def profile_once(frame: FeatureFrame) -> tuple[int, int]:
    """Rows and label-1 rows in one aggregate job."""
    row = frame.df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(LABEL) == 1.0).alias("pos")).first()
    return int(row["rows"]), int(row["pos"])


def train(
    spark: SparkSession,
    input_path: str,
    out: str = "",
    kind: str = "logistic",
    num_iterations: int = DEFAULT_ITERATIONS,
    reg_param: float = DEFAULT_REG_PARAM,
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    frame: FeatureFrame | None = None,
    arguments: tuple[str, ...] | None = None,
    scale: bool = False,
) -> TrainResult:
    """Fit a model on a matrix CSV (or a given frame) and optionally save it.

    With ``scale`` the features are centred and scaled first, an intercept is
    fitted, and the model is folded: it scores raw rows, and carries the moments.
    ``arguments`` is recorded in the model's provenance (default: the options
    used here).
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    if frame is None:
        frame = read_matrix(spark, input_path, target=target, ignore=ignore, max_features=max_features)
    args = arguments if arguments is not None else (
        f"--input={input_path}", f"--kind={kind}", f"--num-iterations={num_iterations}", f"--reg-param={reg_param}",
        *(("--scale",) if scale else ()),
    )
    scaler = Scaler.fit(frame) if scale else None
    if scaler:
        frame = scaler.apply(frame)
    # one persisted copy serves the profile pass and every solver pass, so the
    # input is scanned and parsed once
    data = training_input(frame)
    try:
        rows, positives = profile_once(frame.with_df(data))
        partitions = data.rdd.getNumPartitions()  # of the persisted copy: no job
        log.info("Loaded %d x %d matrix into %d partitions; label=1 on %d rows", rows, frame.width, partitions, positives)
        fit = fit_logistic_l1 if kind == "logistic" else fit_linear
        model = fit(
            frame, reg_param=reg_param, max_iter=num_iterations, fit_intercept=scale, standardization=not scale,
            arguments=args, data=data,
        )
    finally:
        data.unpersist()
    if scaler:
        model = scaler.fold(model)
    if out:
        model.save(spark, out)
    return TrainResult(model, rows, positives, partitions)


def model_report(spark: SparkSession, model: LinearModel) -> tuple[DataFrame, DataFrame]:
    """Ranking and zero-weight summary of a model."""
    weights = model.weights_df(spark)
    return weight_ranking(weights), zero_weight_summary(weights)


def indexed_predictions(frame: FeatureFrame, model: LinearModel, order_by: list[str] | None = None,
                        align_mode: str = "name") -> DataFrame:
    """Scored rows with a dense 0-based ``index``.

    Without ``order_by`` the frame must carry the input-order columns of a
    ``read_matrix(..., keep_order=True)`` scan; the index is then the line
    order of the input files.
    """
    scored = score(frame, model, align_mode)
    if order_by:
        return with_row_index(scored, order_by)
    if not all(c in scored.columns for c in ORDER_COLS):
        raise ValueError("no order given and the frame carries no input-order columns")
    return with_input_order_index(scored, ORDER_COLS[0], ORDER_COLS[1])


def predict(
    spark: SparkSession,
    input_path: str,
    model_path: str,
    out: str = "",
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    row_labels: str = "",
    test: bool = False,
    align_mode: str = "name",
) -> DataFrame:
    """Score a matrix CSV with a saved model; write ``index, prediction`` files.

    ``row_labels`` names a column to carry as the row key instead of the
    input-order index; ``test`` returns the accuracy row instead of the
    predictions (counted during the write when ``out`` is given).
    """
    model = load_model(spark, model_path)
    carry = (row_labels,) if row_labels else ()
    frame = read_matrix(
        spark, input_path, target=target, ignore=ignore, max_features=max_features,
        keep_order=not row_labels, carry=carry, carry_prefix=KEY_PREFIX,
    )
    if row_labels:
        # keyed rows need no global index (and no extra pass to build one)
        out_df = score(frame, model, align_mode)
        id_col = KEY_PREFIX + row_labels
    else:
        out_df = indexed_predictions(frame, model, align_mode=align_mode)
        id_col = "index"
    if out:
        # counted inside the write job (Observation), not in a second pass
        observed, obs = observe_counters(
            out_df, "prediction accuracy",
            rows=F.count("prediction"), unscored=F.count_if(F.col("prediction").isNull()),
            correct=F.count_if(F.col(LABEL) == F.col("prediction")),
        )
        write_predictions(observed, out, index_col=id_col, header_name=row_labels or "index")
        m = obs.get
        log.info("Scored %d rows x %d features; %d rows without a prediction", m["rows"], frame.width, m["unscored"])
        if test:
            acc = m["correct"] / m["rows"] if m["rows"] else None
            return spark.createDataFrame(
                [(m["rows"], m["correct"], m["unscored"], acc)],
                "rows BIGINT, correct BIGINT, unscored BIGINT, accuracy DOUBLE",
            )
    if test:
        return accuracy(out_df)
    if row_labels and row_labels not in out_df.columns:
        out_df = out_df.withColumnRenamed(id_col, row_labels)
    return out_df
