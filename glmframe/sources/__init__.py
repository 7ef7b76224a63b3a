"""Sources and sinks: matrix CSV text, model files, prediction files."""

from glmframe.sources.csv_matrix import (
    cell_array,
    column_names,
    column_profile,
    duplicate_columns,
    first_line,
    matrix_from_lines,
    read_header,
    read_matrix,
    write_matrix_csv,
)
from glmframe.sources.predictions import prediction_lines, write_predictions
from glmframe.sources.model_store import (
    MODEL_SCHEMA,
    LinearModel,
    load_model,
    model_from_weights,
    read_model_df,
    weights_long,
)
from glmframe.sources.wide_model import WideModel, load_wide_model, score_entries

__all__ = [
    "MODEL_SCHEMA",
    "LinearModel",
    "WideModel",
    "cell_array",
    "column_names",
    "column_profile",
    "duplicate_columns",
    "first_line",
    "load_model",
    "load_wide_model",
    "matrix_from_lines",
    "model_from_weights",
    "prediction_lines",
    "read_header",
    "read_matrix",
    "read_model_df",
    "score_entries",
    "weights_long",
    "write_matrix_csv",
    "write_predictions",
]
