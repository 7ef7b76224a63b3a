"""Operators on FeatureFrames and model frames."""

from glmframe.operators.model_report import missing_feature_names, weight_ranking, zero_weight_summary
from glmframe.operators.profile import (
    constant_feature_flags,
    drop_constant_features,
    label_distribution,
    matrix_shape,
    observe_counters,
    positive_rate,
)
from glmframe.operators.row_index import with_input_order_index, with_row_index
from glmframe.operators.scaling import Scaler, standardize
from glmframe.operators.scoring import accuracy, align, confusion_counts, keyed_predictions, score
from glmframe.operators.train import fit_linear, fit_logistic_l1

__all__ = [
    "Scaler",
    "accuracy",
    "align",
    "confusion_counts",
    "constant_feature_flags",
    "drop_constant_features",
    "fit_linear",
    "fit_logistic_l1",
    "keyed_predictions",
    "label_distribution",
    "matrix_shape",
    "missing_feature_names",
    "observe_counters",
    "positive_rate",
    "score",
    "standardize",
    "weight_ranking",
    "with_input_order_index",
    "with_row_index",
    "zero_weight_summary",
]
