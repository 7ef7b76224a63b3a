"""glmframe: labelled numeric matrices, L1 linear models and scoring on Spark."""

from glmframe.frame import LABEL, FeatureFrame
from glmframe.sources.csv_matrix import read_matrix
from glmframe.sources.model_store import LinearModel, load_model

__all__ = ["LABEL", "FeatureFrame", "LinearModel", "load_model", "read_matrix"]
