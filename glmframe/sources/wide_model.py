"""Linear models of any width: the weights are a table of rows, never one value.

A one-row model (``LinearModel``) must fit a JVM array and the driver. Here a
model is a folder of two Parquet tables:

    weights   (idx BIGINT, name STRING, value DOUBLE), one row per feature, in
              part files by ranges of idx
    head      one row: provenance as in the one-row form, intercept, width

Nothing here holds the weights in Python: they are read, ranked
(``weight_ranking``), summarised (``zero_weight_summary``) and applied as
DataFrames. Features of such width come as rows too: ``score_entries`` scores
a table of (row key, feature name, value), absent features counting as 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glmframe.frame import qcol
from glmframe.functions.numeric import logistic, threshold_class
from glmframe.sources.model_store import DEFAULT_KIND, KIND_ATTRIBUTE, KINDS, LinearModel, provenance_column

WEIGHTS_PER_FILE = 4_000_000
#: Names in more than this share of all entries are joined apart (there are fewer than its inverse).
COMMON_SHARE = 1e-3


@dataclass(frozen=True)
class WideModel:
    """``weights`` is (idx, name, value); names are unique."""

    weights: DataFrame
    intercept: float = 0.0
    kind: str = DEFAULT_KIND
    arguments: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, got {self.kind!r}")

    @classmethod
    def of(cls, spark: SparkSession, model: LinearModel) -> WideModel:
        return cls(model.weights_df(spark), model.intercept, model.kind, model.arguments)

    def save(self, path: str) -> str:
        """Write (overwrite) both tables. Duplicate names fail the save: a weight by name would be unclear."""
        spark = self.weights.sparkSession
        weights = self.weights.select(F.col("idx").cast("long").alias("idx"), "name", F.col("value").cast("double").alias("value"))
        again = weights.groupBy("name").count().where("count > 1").select("name").first()
        if again is not None:
            raise ValueError(f"feature name {again['name']!r} occurs more than once")
        width = weights.count()
        files = max(1, -(-width // WEIGHTS_PER_FILE))
        weights.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(f"{path}/weights")
        head = spark.range(1).select(
            provenance_column(self.arguments, {KIND_ATTRIBUTE: self.kind}).alias("provenance"),
            F.lit(float(self.intercept)).alias("intercept"),
            F.lit(width).cast("long").alias("width"),
        )
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        return path


def load_wide_model(spark: SparkSession, path: str) -> WideModel:
    """The head reaches the driver; the weights stay a lazy scan."""
    head = spark.read.parquet(f"{path}/head").first()
    if head is None:
        raise ValueError(f"no model record in {path!r}")
    prov = head["provenance"]
    return WideModel(
        spark.read.parquet(f"{path}/weights"),
        head["intercept"],
        (prov["attributes"] or {}).get(KIND_ATTRIBUTE, DEFAULT_KIND),
        tuple(prov["arguments"] or ()),
    )


def score_entries(
    entries: DataFrame,
    model: WideModel,
    keys: Sequence[str],
    name_col: str = "name",
    value_col: str = "value",
    threshold: float = 0.5,
) -> DataFrame:
    """``keys…, margin, probability, prediction`` per row key of a long table of features.

    Entries of names that the model lacks add nothing, and a NULL value makes
    the row's prediction NULL. Names in many entries would meet in one task:
    they are counted first, and joined as a broadcast table of fewer than
    ``1 / COMMON_SHARE`` weights; all others are joined by name.
    """
    spark = entries.sparkSession
    own = entries.select(*[qcol(k) for k in keys], qcol(name_col).alias("_name"), qcol(value_col).cast("double").alias("_x"))
    weights = model.weights.select(F.col("name").alias("_name"), F.col("value").alias("_w"))
    counts = own.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    total = entries.count()
    names = [r["_name"] for r in counts.where(F.col("_n") > F.lit(max(1.0, COMMON_SHARE * total))).select("_name").collect()]
    common = spark.createDataFrame([(n,) for n in names], "_name STRING")
    is_common = F.broadcast(common)
    rare = own.join(is_common, "_name", "left_anti").join(weights, "_name")
    often = own.join(is_common, "_name", "left_semi").join(F.broadcast(weights.join(is_common, "_name", "left_semi")), "_name")
    terms = rare.unionByName(often).select(*[qcol(k) for k in keys], (F.col("_w") * F.col("_x")).alias("_t"))
    # rows whose features the model all lacks keep their margin, the intercept
    nothing = own.select(*[qcol(k) for k in keys], F.lit(0.0).alias("_t"))
    sums = terms.unionByName(nothing).groupBy(*[qcol(k) for k in keys]).agg(
        F.when(F.count_if(F.col("_t").isNull()) == 0, F.sum("_t")).alias("_sum")
    )
    scored = sums.select(*[qcol(k) for k in keys], (F.col("_sum") + F.lit(float(model.intercept))).alias("margin"))
    if model.kind == "linear":
        return scored.select("*", F.lit(None).cast("double").alias("probability"), F.col("margin").alias("prediction"))
    probability = logistic(F.col("margin"))
    return scored.select("*", probability.alias("probability")).select(
        "*", threshold_class(F.col("probability"), threshold).alias("prediction")
    )
