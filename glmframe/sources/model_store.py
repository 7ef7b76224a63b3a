"""Linear model with feature names: in-memory form, one-row DataFrame, files.

Stored schema (one row per model file):

    provenance  STRUCT<timestamp STRING, user STRING, host STRING,
                       arguments ARRAY<STRING>, attributes MAP<STRING,STRING>>
    intercept   DOUBLE
    weights     ARRAY<STRUCT<name STRING, value DOUBLE>>
    scaling     ARRAY<STRUCT<shift DOUBLE, divisor DOUBLE>>   only in models folded with a scaler

A model is as wide as its feature list, so holding the weights on the driver
(as Spark ML models do) is bounded by the model, not by the data. The long
``(idx, name, value)`` form is produced with ``posexplode`` from the stored
row, so large models never need to be collected to be inspected.
"""

from __future__ import annotations

import getpass
import socket
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE_TYPE = T.StructType(
    [
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("user", T.StringType(), True),
        T.StructField("host", T.StringType(), True),
        T.StructField("arguments", T.ArrayType(T.StringType(), False), False),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), False), False),
    ]
)
WEIGHT_TYPE = T.StructType(
    [T.StructField("name", T.StringType(), True), T.StructField("value", T.DoubleType(), False)]
)
MODEL_SCHEMA = T.StructType(
    [
        T.StructField("provenance", PROVENANCE_TYPE, True),
        T.StructField("intercept", T.DoubleType(), False),
        T.StructField("weights", T.ArrayType(WEIGHT_TYPE, False), False),
    ]
)
SCALING_COLUMN = "scaling"
SCALING_TYPE = T.ArrayType(
    T.StructType([T.StructField("shift", T.DoubleType(), False), T.StructField("divisor", T.DoubleType(), False)]), False
)

# Model kinds; a stored model without a kind scores as logistic.
KINDS = ("logistic", "linear")
KIND_ATTRIBUTE = "kind"
DEFAULT_KIND = "logistic"
# Java Date.toString layout of the provenance timestamp.
TIMESTAMP_FORMAT = "EEE MMM dd HH:mm:ss zzz yyyy"


def provenance_column(
    arguments: Sequence[str] = (), attributes: Mapping[str, str] | None = None, host: str | None = None
) -> Column:
    """Provenance struct as a column: time and user taken by Spark at run time."""
    attrs = dict(attributes or {})
    args = F.array(*[F.lit(str(a)) for a in arguments]) if arguments else F.array().cast("array<string>")
    if attrs:
        kv: list[Column] = []
        for k, v in attrs.items():
            kv += [F.lit(str(k)), F.lit(str(v))]
        amap = F.create_map(*kv)
    else:
        amap = F.create_map().cast("map<string,string>")
    return F.struct(
        F.date_format(F.current_timestamp(), TIMESTAMP_FORMAT).alias("timestamp"),
        F.coalesce(F.current_user(), F.lit(getpass.getuser())).alias("user"),
        F.lit(host or socket.gethostname()).alias("host"),
        args.alias("arguments"),
        amap.alias("attributes"),
    )


class Scaling(NamedTuple):
    """Moments of one feature in training: subtracted, and divided by (0.0: no deviation)."""

    shift: float
    divisor: float


@dataclass(frozen=True)
class LinearModel:
    """Weights of raw features; ``scaling`` holds the moments of a model that was trained on scaled ones."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float = 0.0
    kind: str = DEFAULT_KIND
    arguments: tuple[str, ...] = field(default=())
    scaling: tuple[Scaling, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.names) != len(self.weights):
            raise ValueError(f"{len(self.names)} feature names but {len(self.weights)} weights")
        if self.scaling is not None and len(self.scaling) != len(self.weights):
            raise ValueError(f"{len(self.scaling)} moments but {len(self.weights)} weights")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, got {self.kind!r}")

    # --------------------------------------------------------------- frames
    def to_df(self, spark: SparkSession, with_provenance: bool = True) -> DataFrame:
        """The model as one row with the stored schema."""
        row = [float(self.intercept), [(n, float(w)) for n, w in zip(self.names, self.weights)]]
        fields = MODEL_SCHEMA.fields[1:]
        if self.scaling is not None:
            row.append([(float(s.shift), float(s.divisor)) for s in self.scaling])
            fields = [*fields, T.StructField(SCALING_COLUMN, SCALING_TYPE, True)]
        base = spark.createDataFrame([tuple(row)], T.StructType(fields))
        if with_provenance:
            prov = provenance_column(self.arguments, {KIND_ATTRIBUTE: self.kind})
        else:
            prov = F.lit(None).cast(PROVENANCE_TYPE)
        return base.select(prov.alias("provenance"), *base.columns)

    def weights_df(self, spark: SparkSession) -> DataFrame:
        """Long form ``(idx, name, value)``."""
        return weights_long(self.to_df(spark, with_provenance=False))

    # ---------------------------------------------------------------- files
    def save(self, spark: SparkSession, path: str, fmt: str | None = None) -> str:
        """Write (overwrite) one model file set; ``fmt`` is parquet, json or avro
        (default: as :func:`model_format` says)."""
        self.to_df(spark).coalesce(1).write.mode("overwrite").format(fmt or model_format(path)).save(path)
        return path


def model_format(path: str) -> str:
    """Storage format implied by a model path: ``.json``, ``.avro``, else parquet.

    Avro needs Spark's Avro module on the class path; Spark's error says so
    where it is missing.
    """
    name = path.rstrip("/").lower()
    return next((f for f in ("json", "avro") if name.endswith(f".{f}")), "parquet")


def weights_long(model_df: DataFrame) -> DataFrame:
    """``(idx, name, value)`` from a stored-model row, without collecting it."""
    return model_df.select(F.posexplode("weights").alias("idx", "w")).select(
        F.col("idx").cast("int").alias("idx"), F.col("w.name").alias("name"), F.col("w.value").alias("value")
    )


def read_model_df(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The stored model row(s) as a DataFrame (schema enforced for json)."""
    return _stored(spark, path, fmt).select(*[f.name for f in MODEL_SCHEMA.fields])


def _stored(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    """The stored row(s) with ``scaling``, NULL in files without it."""
    fmt = fmt or model_format(path)
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(T.StructType([*MODEL_SCHEMA.fields, T.StructField(SCALING_COLUMN, SCALING_TYPE, True)]))
    stored = reader.load(path)
    scaling = F.col(SCALING_COLUMN) if SCALING_COLUMN in stored.columns else F.lit(None).cast(SCALING_TYPE).alias(SCALING_COLUMN)
    return stored.select(*[f.name for f in MODEL_SCHEMA.fields], scaling)


def load_model(spark: SparkSession, path: str, fmt: str | None = None) -> LinearModel:
    """First stored model; kind from provenance (logistic when absent)."""
    rows = _stored(spark, path, fmt).limit(1).collect()
    if not rows:
        raise ValueError(f"no model record in {path!r}")
    return model_from_row(rows[0])


def model_from_row(row) -> LinearModel:
    prov = row["provenance"]
    kind = DEFAULT_KIND
    arguments: tuple[str, ...] = ()
    if prov is not None:
        attrs = prov["attributes"] or {}
        kind = attrs.get(KIND_ATTRIBUTE, DEFAULT_KIND)
        arguments = tuple(prov["arguments"] or ())
    weights = row["weights"] or []
    scaling = row[SCALING_COLUMN] if SCALING_COLUMN in row else None
    return LinearModel(
        names=tuple(w["name"] for w in weights),
        weights=tuple(float(w["value"]) for w in weights),
        intercept=float(row["intercept"] or 0.0),
        kind=kind,
        arguments=arguments,
        scaling=None if scaling is None else tuple(Scaling(x["shift"], x["divisor"]) for x in scaling),
    )


def model_from_weights(weights_df: DataFrame, intercept: float = 0.0, kind: str = DEFAULT_KIND) -> LinearModel:
    """Model from a long ``(idx, name, value)`` frame computed by Spark.

    The frame holds one row per feature (model-sized), so it is collected.
    """
    rows = weights_df.select("idx", "name", "value").orderBy("idx").collect()
    return LinearModel(tuple(r["name"] for r in rows), tuple(float(r["value"]) for r in rows), intercept, kind)
