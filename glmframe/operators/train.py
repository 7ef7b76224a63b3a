"""Training linear models on a FeatureFrame with Spark ML.

The solver is Spark's own (L-BFGS / OWL-QN with ``treeAggregate`` of the
gradients): every iteration is one distributed pass over the cached input,
and only feature-sized vectors travel between driver and executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from glmframe.frame import LABEL, FeatureFrame
from glmframe.sources.model_store import LinearModel


def training_input(frame: FeatureFrame) -> DataFrame:
    """Assembled input, persisted for the fit.

    The solver makes one pass per iteration, so the input is persisted
    (memory, spilling to disk) by us, once, instead of being re-derived for
    every pass; lost blocks are recomputed from lineage. It is never shuffled:
    a caller whose input has too few partitions repartitions it. The caller
    unpersists after the fit.
    """
    return frame.assembled("features").persist(StorageLevel.MEMORY_AND_DISK)


# the partial gradients that reach the driver in one iteration stay below this
DRIVER_MERGE_BYTES = 128 * 1024 * 1024


def tree_depth(partitions: int, width: int, budget: int = DRIVER_MERGE_BYTES) -> int:
    """Smallest ``treeAggregate`` depth (at least 2) whose last level sends
    at most ``budget`` bytes of partial gradients to the driver.

    With depth d about ``partitions ** (1/d)`` partials of ``8 * width``
    bytes arrive per iteration: 100k partitions and a million features need
    depth 5; a few thousand partitions or narrow models keep the default 2.
    """
    per_partial = 8 * max(1, width) + 64
    if per_partial > budget:
        raise ValueError(f"one gradient of {width} features exceeds the budget of {budget} bytes")
    depth = 2
    while (max(1, partitions) ** (1.0 / depth)) * per_partial > budget:
        depth += 1
    return depth


def _fit(estimator, frame: FeatureFrame, data: DataFrame | None, depth: int | None):
    """Fit on the caller's persisted input, or on one built (and released) here.

    The tree-aggregation depth is set from the input's partition count and the
    model width unless given.
    """
    own = None
    if data is None:
        data = own = training_input(frame)
    try:
        if estimator.hasParam("aggregationDepth"):
            if own is not None:
                data.count()  # fills the persisted copy, whose partitions are known then
            chosen = depth or tree_depth(data.rdd.getNumPartitions(), frame.width)
            estimator = estimator.copy({estimator.getParam("aggregationDepth"): chosen})
        return estimator.fit(data)
    finally:
        if own is not None:
            own.unpersist()


# Defaults of the training command.
DEFAULT_ITERATIONS = 200
DEFAULT_REG_PARAM = 1.0


def fit_logistic_l1(
    frame: FeatureFrame,
    reg_param: float = DEFAULT_REG_PARAM,
    max_iter: int = DEFAULT_ITERATIONS,
    fit_intercept: bool = False,
    standardization: bool = True,
    tol: float = 1e-6,
    aggregation_depth: int | None = None,
    arguments: tuple[str, ...] = (),
    data: DataFrame | None = None,
) -> LinearModel:
    """L1-regularised binary logistic regression; labels must be 0/1.

    With the default ``reg_param=1.0`` the all-zero model is common; pass a
    smaller value for data whose signal is weak. ``data`` is a persisted
    ``training_input(frame)`` that the caller already holds and releases.
    ``aggregation_depth`` defaults to :func:`tree_depth` of the input.
    """
    lr = LogisticRegression(
        featuresCol="features",
        labelCol=LABEL,
        maxIter=max_iter,
        regParam=reg_param,
        elasticNetParam=1.0,
        fitIntercept=fit_intercept,
        standardization=standardization,
        family="binomial",
        tol=tol,
    )
    fitted = _fit(lr, frame, data, aggregation_depth)
    return LinearModel(
        names=frame.feature_names,
        weights=tuple(float(w) for w in fitted.coefficients.toArray()),
        intercept=float(fitted.intercept),
        kind="logistic",
        arguments=arguments,
    )


def fit_linear(
    frame: FeatureFrame,
    reg_param: float = DEFAULT_REG_PARAM,
    max_iter: int = DEFAULT_ITERATIONS,
    fit_intercept: bool = False,
    elastic_net: float = 1.0,
    standardization: bool = True,
    solver: str = "auto",
    arguments: tuple[str, ...] = (),
    data: DataFrame | None = None,
) -> LinearModel:
    """Least-squares linear model (L1 by default, i.e. the lasso).

    ``data`` as in :func:`fit_logistic_l1`.
    """
    lin = LinearRegression(
        featuresCol="features",
        labelCol=LABEL,
        maxIter=max_iter,
        regParam=reg_param,
        elasticNetParam=elastic_net,
        fitIntercept=fit_intercept,
        standardization=standardization,
        solver=solver,
    )
    fitted = _fit(lin, frame, data, None)
    return LinearModel(
        names=frame.feature_names,
        weights=tuple(float(w) for w in fitted.coefficients.toArray()),
        intercept=float(fitted.intercept),
        kind="linear",
        arguments=arguments,
    )
