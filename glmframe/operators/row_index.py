"""Dense 0-based row index in a given order, without one task doing it all.

A ``row_number()`` window without partitioning would pull every row into one
task. Instead:

* **keyed order** (:func:`with_row_index`): rows are range-partitioned and
  sorted by the key, a hash of the whole row and the row's place in the
  source, so a hot key, and rows that are equal in every column, spread over
  as many partitions as their number needs. That order is written once (a
  reliable checkpoint); a row's index is the start of its partition plus its
  place there, both 64-bit.
* **input order of text files** (:func:`with_input_order_index`): rows never
  move. Count the rows of every input split, prefix-sum the counts in (file,
  split start) order, and look each row's split up in an array by partition
  number; index = offset of the split + position inside it. The array is one
  literal of four numbers per split, and the driver plans every split anyway.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glmframe.frame import qcol
from glmframe.session import ensure_checkpoint_dir

ROWS_PER_BUCKET = 2_000_000
#: Bits of a monotonically increasing id that count rows within a partition.
_ROW_BITS = 33


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    index_col: str = "index",
    num_partitions: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``index_col`` = 0-based position in ``order_by`` order (names, or columns with a direction).

    Ties on ``order_by`` are ordered by a hash of the whole row, then by the
    place in the source. The partition count follows from the row count (one
    count without columns) unless it is given.
    """
    n = num_partitions or max(1, math.ceil(df.count() / max(1, rows_per_bucket)))
    keyed = df.withColumns(
        {"_tie": F.xxhash64(*[qcol(c) for c in df.columns]), "_at": F.monotonically_increasing_id()}
    )
    order = [*(qcol(c) if isinstance(c, str) else c for c in order_by), F.col("_tie"), F.col("_at")]
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie", "_at")
    ensure_checkpoint_dir(df.sparkSession)
    written = ranged.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    written = written.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of ``rows_per_bucket`` rows: safe to broadcast
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = written.join(F.broadcast(offsets), on="_part", how="inner")
    return joined.select(*[qcol(c) for c in df.columns], (F.col("_start") + place).cast("long").alias(index_col))


def with_input_order_index(df: DataFrame, file_col: str, block_col: str, index_col: str = "index") -> DataFrame:
    """Index in the order of the input files (path order, then file offset).

    ``df`` must come from a file scan through narrow operations only (select,
    filter), carrying the file path and split start of every row, so that the
    rows of one split are still contiguous and in file order inside a task.
    The within-split position is taken here, after every filter.
    """
    with_id = df.withColumn("_rid", F.monotonically_increasing_id()).withColumns(
        {"_part": F.shiftright("_rid", _ROW_BITS), "_file": F.xxhash64(qcol(file_col)), "_block": qcol(block_col)}
    )
    place = F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    splits = with_id.groupBy("_part", "_file", "_block", qcol(file_col).alias("_path")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")
    )
    order = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_first")
    index = place + _split_shift(splits.select("_part", "_file", "_block", shift.alias("_shift")))
    return with_id.select(*[qcol(c) for c in df.columns], index.alias(index_col))


def _split_shift(splits: DataFrame) -> Column:
    """What a split's rows add to their place in the partition, looked up by (_part, _file, _block).

    One list of splits per partition, most often of one. A row whose split
    isn't there fails the job: the scan was planned otherwise than when counted.
    """
    lists: dict[int, list[list[int]]] = defaultdict(list)
    for part, file, block, shift in splits.toLocalIterator():
        lists[part].append([file, block, shift])
    table = [lists[i] for i in range(max(lists, default=-1) + 1)]
    found = F.get(F.from_json(F.lit(json.dumps(table)), "array<array<array<bigint>>>"), F.col("_part").cast("int"))
    own = F.filter(found, lambda s: (s[0] == F.col("_file")) & (s[1] == F.col("_block")))
    missing = F.raise_error(F.lit("the input splits changed between counting and indexing")).cast("bigint")
    return F.coalesce(F.get(F.get(own, F.lit(0)), F.lit(2)), missing)
