"""Model report: weight ranking, zero-weight summary, missing features.

All three work on the long weights frame ``(idx, name, value)``, one row per
model feature. The ranking is a range exchange over those rows with an offset
per partition, so a model of any width is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.operators.row_index import with_row_index

# Fixed value: layout of one ranking line.
RANKING_LINE = " [%10d] %20s = %.15f"


def weight_ranking(weights: DataFrame) -> DataFrame:
    """Non-zero weights by |value| descending, ties in index order.

    ``(rank, idx, name, value, line)``; ``rank`` is 1-based.
    """
    nonzero = weights.where(F.col("value") != F.lit(0.0)).select("idx", "name", "value")
    ranked = with_row_index(nonzero, [F.abs("value").desc(), F.col("idx").asc()])
    return ranked.select(
        (F.col("index") + 1).alias("rank"),
        "idx",
        "name",
        "value",
        F.format_string(RANKING_LINE, F.col("idx"), F.col("name"), F.col("value")).alias("line"),
    )


def zero_weight_summary(weights: DataFrame) -> DataFrame:
    """One row ``(zero, total, percent)`` of weights equal to 0.0."""
    agg = weights.agg(
        F.count_if(F.col("value") == F.lit(0.0)).alias("zero"), F.count(F.lit(1)).alias("total")
    )
    pct = F.when(F.col("total") > 0, F.col("zero") * F.lit(100.0) / F.col("total"))
    return agg.select("zero", "total", pct.alias("percent"))


def missing_feature_names(weights: DataFrame, available: DataFrame, name_col: str = "name") -> DataFrame:
    """Model feature names absent from ``available`` (an anti-join on the name)."""
    have = available.select(F.col(name_col).alias("name")).distinct()
    return weights.select("idx", "name").join(have, on="name", how="left_anti")
