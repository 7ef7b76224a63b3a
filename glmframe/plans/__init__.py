"""End-to-end jobs built from the operators."""

from glmframe.plans.commands import indexed_predictions, model_report, predict, train

__all__ = ["indexed_predictions", "model_report", "predict", "train"]
