"""Running totals within groups, none of which has to fit one task.

A window ordered within a group sorts the whole group in one task. Here rows
are range-partitioned by (group, order) instead, so a hot group, and rows of
it that are equal in every column, spread over as many partitions as their
number needs, and that order is written once (a reliable checkpoint). Totals
then have two levels: the sum of a group's rows in each partition, summed over
the partitions before (one row per group and partition), and the running sum
within a partition's part of the group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glmframe.frame import qcol
from glmframe.operators.row_index import ROWS_PER_BUCKET
from glmframe.session import ensure_checkpoint_dir

_ROW_BITS = 33


def with_running_total(
    df: DataFrame,
    group_cols: Sequence[str],
    order_by: Sequence[str | Column],
    value: Column,
    total_col: str = "total_before",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``total_col``: the sum of ``value`` over the rows of the group that come before, 0 for the first.

    Ties on ``order_by`` are ordered by a hash of the whole row, then by the
    place in the source. NULL is a group like any other, and a NULL value adds
    nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    groups = {f"_g{i}": qcol(c) for i, c in enumerate(group_cols)}
    n = max(1, math.ceil(df.count() / max(1, rows_per_bucket)))
    keyed = df.withColumns(
        {"_v": F.coalesce(value, F.lit(0)), "_tie": F.xxhash64(*[qcol(c) for c in df.columns]), "_at": F.monotonically_increasing_id()}
    )
    order = [*(qcol(c) for c in group_cols), *(qcol(c) if isinstance(c, str) else c for c in order_by), "_tie", "_at"]
    sorted_ = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie", "_at")
    written = sorted_.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    written = written.withColumns({"_part": F.shiftright("_id", _ROW_BITS), **groups})

    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("_part", *groups).agg(F.sum("_v").alias("_sum"))
    parts = parts.select("_part", *groups, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # a partition's part of a group has no more rows than the partition
    inside = Window.partitionBy("_part", *groups).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    running = written.withColumn("_run", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = [F.col("a._part") == F.col("b._part"), *(F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups)]
    joined = running.alias("a").join(parts.alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("_run") + F.col("_start")).alias(total_col))
