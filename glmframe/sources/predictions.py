"""Prediction sink: ``index, prediction`` text written by every task.

Each part file starts with the header line ``index, prediction`` and holds
``<index>, <prediction %f>`` lines sorted by index within the file. Nothing
is collected: the index comes from the distributed row index and the write
is a plain parallel text write. A reader that drops repeated header lines
(``read_matrix`` does) gets the whole set back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.functions.numeric import format_fixed

# Layout of the prediction file.
PREDICTION_HEADER = "index, prediction"
PREDICTION_SEPARATOR = ", "


def prediction_lines(indexed: DataFrame, index_col: str = "index", value_col: str = "prediction") -> DataFrame:
    """``(index, line)`` with ``line = '<index>, <value %f>'``."""
    line = F.concat(F.col(index_col).cast("string"), F.lit(PREDICTION_SEPARATOR), format_fixed(value_col, 6))
    return indexed.select(F.col(index_col).alias("index"), line.alias("line"))


def write_predictions(
    indexed: DataFrame,
    path: str,
    index_col: str = "index",
    value_col: str = "prediction",
    header_name: str | None = None,
) -> str:
    """Write ``index, prediction`` CSV text (header in every part file).

    With a key column instead of the index (keyed predictions) the header
    names that column, or ``header_name`` where it is given.
    """
    out = indexed.select(F.col(f"`{index_col}`").alias("_id"), format_fixed(value_col, 6).alias("prediction"))
    out = out.sortWithinPartitions("_id").toDF(header_name or index_col, "prediction")
    (
        out.write.mode("overwrite")
        .option("header", "true")
        .option("sep", PREDICTION_SEPARATOR)
        .option("quoteAll", "false")
        .csv(path)
    )
    return path
