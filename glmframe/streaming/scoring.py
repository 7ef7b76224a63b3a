"""Structured Streaming: score matrix CSV files as they arrive.

Parsing (``parse_lines``) and scoring are stateless projections and filters,
so the streaming plan is the batch plan on an unbounded input: no state
store, no watermark, no shuffle. The file sink with a checkpoint under the
shared checkpoint folder gives exactly-once output and restarts from the
last committed batch after a failure.

Every micro-batch counts its rows with and without a prediction in the same
job (an observed metric of the plan); :class:`ScoringCounters` collects them
from the query's progress, batch by batch.

The input-order index of the batch job is not offered on a stream (a stream
has no global order); rows are identified by a key column instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glmframe.frame import FeatureFrame
from glmframe.operators.scoring import keyed_predictions, score
from glmframe.session import scratch_path
from glmframe.sources.csv_matrix import matrix_from_lines
from glmframe.sources.model_store import LinearModel

#: Name of the observed metric of a scoring stream.
COUNTERS = "scoring"


@dataclass
class ScoringCounters:
    """Rows with and without a prediction, per micro-batch of a scoring stream.

    A query keeps its last progress reports only
    (``spark.sql.streaming.numRecentProgressUpdates``, 100): call ``update``
    at least that often while it runs. Batches that were missed are an error,
    never a lower total; a query that goes on from a checkpoint begins with
    the first batch of its own run.
    """

    batches: dict[int, tuple[int, int]] = field(default_factory=dict)

    def update(self, query: StreamingQuery) -> ScoringCounters:
        """Take in the batches that the query has reported since."""
        for report in query.recentProgress:
            found = report.observedMetrics.get(COUNTERS)
            if found is not None and report.batchId not in self.batches:
                self.batches[report.batchId] = (found["scored"], found["unscored"])
        if self.batches and len(self.batches) != max(self.batches) - min(self.batches) + 1:
            raise RuntimeError("progress reports were dropped before they were read: update the counters more often")
        return self

    @property
    def scored(self) -> int:
        return sum(s for s, _ in self.batches.values())

    @property
    def unscored(self) -> int:
        return sum(u for _, u in self.batches.values())

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per batch: ``(batch, scored, unscored)``."""
        rows = [(b, *counts) for b, counts in sorted(self.batches.items())]
        return spark.createDataFrame(rows, "batch BIGINT, scored BIGINT, unscored BIGINT")


def read_matrix_stream(
    spark: SparkSession,
    folder: str,
    header: Sequence[str],
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    on_error: str = "raise",
    carry: Sequence[str] = (),
    max_files_per_trigger: int | None = None,
    packed: bool = False,
) -> FeatureFrame:
    """A streaming FeatureFrame over the CSV text files arriving in ``folder``.

    The header is given (a stream has no "first line"); lines equal to it
    are dropped as in the batch reader.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(int(max_files_per_trigger)))
    lines = reader.load(folder)
    return matrix_from_lines(lines, header, target, ignore, max_features, on_error, carry, packed=packed)


def start_keyed_scoring(
    frame: FeatureFrame,
    model: LinearModel,
    keys: list[str],
    out_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    align_mode: str = "name",
) -> StreamingQuery:
    """Start a query writing ``keys…, prediction`` parquet files to ``out_path``."""
    spark = frame.df.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-checkpoint")
    scored = score(frame, model, align_mode).observe(
        COUNTERS, F.count("prediction").alias("scored"), F.count_if(F.col("prediction").isNull()).alias("unscored")
    )
    out = keyed_predictions(scored, keys)
    writer = out.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.outputMode("append").start()
