"""Grouped, length-bounded listing of text pieces ("a,b,c [...]").

Per group, pieces are taken in order while the remaining character budget
*before* a piece is larger than the ellipsis; each taken piece costs its
length plus the separator, and a separator follows every taken piece that
has a successor. If pieces were left out the ellipsis is appended.

Scale: a hot group must not be sorted in one task. A piece at rank ``k``
(0-based) costs at least ``len(sep)``, so with a non-empty separator only
ranks ``k < (budget - len(ellipsis)) / len(sep)`` can ever be taken. The
ranking filter ``row_number() <= cap`` is applied by Spark as a partial
window group limit *before* the shuffle, so at most ``cap`` rows per group
per map partition move. The number of pieces per group (needed to decide on
the ellipsis) is a separate partial aggregate. No rows are dropped from the
answer: the cap is exact, not a sample.

An empty separator has no such cap, since empty pieces cost nothing. There
the characters spent before every piece are running totals over
range-partitioned pieces (``with_running_total``), and no group is sorted in
one task; of the kept pieces only those with text are gathered, which the
budget bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default separator and ellipsis of a truncated listing.
DEFAULT_SEPARATOR = ","
DEFAULT_ELLIPSIS = " [...]"


def rank_cap(max_length: int, separator: str, ellipsis: str) -> int | None:
    """Exact upper bound on the number of pieces that can be taken, or None."""
    if not separator:
        return None
    room = max_length - len(ellipsis)
    if room <= 0:
        return 1
    return math.ceil(room / len(separator)) + 1


def truncated_listing(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    piece_col: str,
    max_length: int,
    separator: str = DEFAULT_SEPARATOR,
    ellipsis: str = DEFAULT_ELLIPSIS,
    out_col: str = "listing",
) -> DataFrame:
    """One row per group: ``group_cols`` + ``out_col`` (the truncated text).

    ``order_col`` fixes the piece order inside a group; ties are broken by
    the piece text so the answer is deterministic.
    """
    group_cols = list(group_cols)
    pieces = df.select(*group_cols, F.col(order_col).alias("_k"), F.col(piece_col).cast("string").alias("_p"))
    totals = pieces.groupBy(*group_cols).agg(F.count("_p").alias("_n_total"))
    pieces = pieces.where(F.col("_p").isNotNull())

    cap = rank_cap(max_length, separator, ellipsis)
    cost = F.length("_p") + F.lit(len(separator))
    if cap is None:
        from glmframe.operators.prefix_sums import with_running_total

        head = with_running_total(pieces, group_cols, ["_k", "_p"], cost, "_spent")
    else:
        order = Window.partitionBy(*group_cols).orderBy("_k", "_p")
        head = pieces.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)
        before = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1))
        head = head.withColumn("_spent", F.coalesce(before, F.lit(0)))
    head = head.withColumn("_keep", (F.lit(max_length) - F.col("_spent")) > F.lit(len(ellipsis)))
    # without a separator, empty pieces leave no trace in the text
    shown = F.col("_keep") & (F.lit(bool(separator)) | (F.col("_p") != ""))
    kept = head.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("_k", "_p")))).alias("_kept"),
        F.count_if(F.col("_keep")).alias("_n_kept"),
    )
    # NULL is a group like any other; a group of NULL pieces alone has an empty text
    same = [totals[c].eqNullSafe(kept[c]) for c in group_cols]
    joined = totals.join(kept, on=same, how="left")
    n_kept = F.coalesce(F.col("_n_kept"), F.lit(0))
    text = F.coalesce(F.array_join(F.transform("_kept", lambda x: x["_p"]), separator), F.lit(""))
    tail = (
        F.when(F.col("_n_total") > n_kept, F.when(n_kept > 0, F.lit(separator + ellipsis)).otherwise(F.lit(ellipsis)))
        .otherwise(F.lit(""))
    )
    return joined.select(*[totals[c] for c in group_cols], F.concat(text, tail).alias(out_col))

