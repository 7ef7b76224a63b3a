"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads whole tables (or CSV text that Spark writes from them into
the shared scratch folder) and runs the library's operators on them. Each
key has a DuckDB statement computing the same answer from the parquet views,
with identical column names; doubles that depend on summation order are
rounded on both sides, and ``+ 0.0`` folds a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glmframe.frame import LABEL, FeatureFrame
from glmframe.functions.listing import truncated_listing
from glmframe.functions.numeric import boolean_as_number, lenient_number
from glmframe.operators.model_report import missing_feature_names, weight_ranking, zero_weight_summary
from glmframe.operators.profile import (
    constant_feature_flags,
    drop_constant_features,
    label_distribution,
    matrix_shape,
    observe_counters,
    positive_rate,
)
from glmframe.operators.row_index import with_row_index
from glmframe.operators.scaling import Scaler, standardize
from glmframe.operators.scoring import accuracy, confusion_counts, keyed_predictions, score
from glmframe.operators.train import fit_linear, fit_logistic_l1
from glmframe.plans.commands import predict, train
from glmframe.session import scratch_path
from glmframe.sources.csv_matrix import column_profile, duplicate_columns, read_matrix, write_matrix_csv
from glmframe.sources.model_store import LinearModel, load_model, model_from_weights, read_model_df, weights_long
from glmframe.sources.predictions import PREDICTION_HEADER, prediction_lines
from glmframe.sources.wide_model import WideModel, load_wide_model, score_entries
from glmframe.streaming.scoring import ScoringCounters, read_matrix_stream, start_keyed_scoring

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]
LINEITEM_NON_FEATURES = "l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate"

# A fixed model over the learnable lineitem features, and one over events.
LINEITEM_MODEL = LinearModel(("q", "l_discount", "l_tax"), (0.08, -3.0, 5.0), -0.1)
EVENTS_MODEL = LinearModel(("value", "user_id"), (0.01, -0.02), 0.5)
LEARN_REG_PARAM = 0.1
TRAIN_JOB_REG_PARAM = 0.02
LASSO_REG_PARAM = 1000.0
LISTING_BUDGET = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def learn_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """lineitem with a learnable label: label = l_quantity > 25."""
    li = table(spark, sf_dir, "lineitem")
    return FeatureFrame.from_columns(
        li,
        {"q": F.col("l_quantity") - F.lit(25.5), "l_discount": "l_discount", "l_tax": "l_tax"},
        label=(F.col("l_quantity") > 25).cast("double"),
        carry=LINEITEM_KEYS,
    )


def lineitem_numeric(spark: SparkSession, sf_dir: str, target: str | None = None) -> FeatureFrame:
    """lineitem's measure columns as features, keys carried."""
    return FeatureFrame.from_table(
        table(spark, sf_dir, "lineitem"), target=target, ignore=LINEITEM_NON_FEATURES, carry=LINEITEM_KEYS
    )


def events_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    ev = table(spark, sf_dir, "events")
    return FeatureFrame.from_columns(
        ev, ["value", "user_id"], label=(F.col("event_type") == "purchase").cast("double"), carry=["event_id"]
    )


def centroid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model learned by aggregation: per embedding dimension, the difference
    of the class means (label >= 5 vs < 5), rounded to 2 places.

    posexplode + groupBy(idx) combines map-side, so each task ships one
    partial row per dimension whatever the row count.
    """
    emb = table(spark, sf_dir, "embeddings")
    ex = emb.select((F.col("label") >= 5).alias("pos"), F.posexplode("embedding").alias("idx", "v"))
    agg = ex.groupBy("idx").agg(
        (F.avg(F.when(F.col("pos"), F.col("v"))) - F.avg(F.when(~F.col("pos"), F.col("v")))).alias("d")
    )
    return agg.select(
        F.col("idx").cast("int").alias("idx"),
        F.concat(F.lit("e"), F.col("idx").cast("string")).alias("name"),
        rounded("d", 2).alias("value"),
    )


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


# ------------------------------------------------------------------ queries
def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", F.lit(" TRUE")).otherwise(F.lit("false "))
    src = li.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", flag.alias("Y"))
    paths = write_matrix_csv(src, _scratch(spark, "csv-scan"))
    fr = read_matrix(spark, paths, target="Y", ignore=" l_orderkey , ")
    return fr.df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        *[rounded(F.sum(f"f_{i}"), 2).alias(f"sum_{n[2:]}") for i, n in enumerate(fr.feature_names)],
    )


def q_csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    src = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    paths = write_matrix_csv(src, _scratch(spark, "csv-header"))
    return column_profile(spark, paths)


def q_duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linestatus") == "O", F.lit("true")).otherwise(F.lit("FALSE"))
    src = li.select("l_discount", "l_tax", "l_quantity", flag.alias("Y"))
    paths = write_matrix_csv(src, _scratch(spark, "dup-cols"), header=["a", "b", "a", "Y"])
    return read_matrix(spark, paths, target="Y").to_df(named=False)


def q_header_rows_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    flag = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("True")).otherwise(F.lit("false"))
    src = cu.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"),
        flag.alias("Y"),
    )
    header_like = spark.createDataFrame(
        [(" c_custkey", "c_nationkey ", "\tc_acctbal", "Y"), ("c_custkey", "c_nationkey", "c_acctbal", "Y")],
        src.schema,
    )
    path = _scratch(spark, "header-rows")
    (
        src.unionByName(header_like)
        .write.option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    return read_matrix(spark, path, target="Y").to_df()


def q_lenient_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "view", F.lit(" TRUE "))
        .when(F.col("event_type") == "click", F.lit("\tfalse"))
        .when(F.col("event_type") == "purchase", F.concat(F.floor("value").cast("string"), F.lit("d")))
        .when(F.col("event_type") == "error", F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("D ")))
        .otherwise(F.col("value").cast("string"))
    )
    return ev.select("event_id", lenient_number(text).alias("x"))


def q_boolean_as_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.when(
        F.col("o_orderstatus") == "F",
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("TRUE")).otherwise(F.lit("true")),
    ).otherwise(F.lit("False"))
    return o.select("o_orderkey", boolean_as_number(text).alias("x"))


def q_label_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return FeatureFrame.from_table(lab, target="quality", carry=["doc_id"]).to_df()


def q_unlabelled_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_numeric(spark, sf_dir, target=None).to_df()


def _feature_select(spark: SparkSession, sf_dir: str, max_features: int | None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fr = FeatureFrame.from_table(
        li,
        target="l_tax",
        ignore="l_returnflag, l_linestatus , l_shipdate,,l_partkey",
        max_features=max_features,
        carry=LINEITEM_KEYS,
    )
    return fr.to_df()


def q_feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_select(spark, sf_dir, None)


def q_feature_select_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_select(spark, sf_dir, 2)


def q_project_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = lineitem_numeric(spark, sf_dir, target="l_discount")
    return fr.project(["l_tax", "l_quantity", "l_tax"]).to_df(named=False)


def q_project_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = lineitem_numeric(spark, sf_dir, target="l_discount")
    return fr.project_by_index([2, 0]).to_df()


def q_transform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fr = FeatureFrame.from_columns(
        o, ["o_totalprice", "o_custkey"], label=(F.col("o_orderstatus") == "F").cast("double"), carry=["o_orderkey"]
    )
    out = fr.transform(
        lambda df: df.withColumn("f_0", rounded(F.log1p("f_0"), 6)).withColumn("f_1", rounded(F.sqrt("f_1"), 6))
    )
    return out.to_df()


def q_matrix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_shape(lineitem_numeric(spark, sf_dir))


def q_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_distribution(FeatureFrame.from_table(table(spark, sf_dir, "labels"), target="quality", carry=["doc_id"]))


def q_label_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = positive_rate(learn_frame(spark, sf_dir))
    return pr.select("positives", "total", rounded("percent").alias("percent"))


def constants_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """lineitem plus a constant, a partly-NaN, an all-NaN and a signed-zero column."""
    li = table(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    return FeatureFrame.from_columns(
        li,
        {
            "l_quantity": "l_quantity",
            "one": F.lit(1.0),
            "nan_some": F.when(F.col("l_linenumber") == 1, nan).otherwise(F.lit(1.0)),
            "nan_all": nan,
            "signed_zero": F.when(F.col("l_orderkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)),
            "l_tax": "l_tax",
        },
        label=(F.col("l_quantity") > 25).cast("double"),
        carry=LINEITEM_KEYS,
    )


def q_constant_feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant_feature_flags(constants_frame(spark, sf_dir))


def q_drop_constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_constant_features(constants_frame(spark, sf_dir)).to_df()


def q_standardize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = standardize(lineitem_numeric(spark, sf_dir))
    df = fr.to_df()
    return df.select(*[rounded(c).alias(c) if c in fr.feature_names else F.col(c) for c in df.columns])


def _scored_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(learn_frame(spark, sf_dir), LINEITEM_MODEL)


def q_score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_fixed(spark, sf_dir).select(*LINEITEM_KEYS, rounded("margin").alias("margin"))


def q_score_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_fixed(spark, sf_dir).select(*LINEITEM_KEYS, rounded("probability").alias("probability"))


def q_score_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_fixed(spark, sf_dir).select(*LINEITEM_KEYS, "prediction")


def q_score_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = accuracy(_scored_fixed(spark, sf_dir))
    return acc.select("rows", "correct", "unscored", rounded("accuracy").alias("accuracy"))


def _events_with_missing(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Events as text cells, every seventh value no number."""
    ev = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    cells = ev.select("event_id", text.alias("value"), "user_id", (F.col("event_type") == "purchase").alias("Y"))
    return FeatureFrame.from_table(cells, target="Y", carry=["event_id"], on_error="null")


def q_score_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_events_with_missing(spark, sf_dir), EVENTS_MODEL).select("event_id", "label", "prediction")


def q_csv_quoted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text (commas, quotes, backslashes put in) as a quoted cell beside numbers, read back."""
    docs = table(spark, sf_dir, "documents")
    told = F.concat(F.lit('"\\'), F.regexp_replace("text", "[\\r\\n]+", " "), F.lit(',\\"'))
    src = docs.select("doc_id", told.alias("text"), "n_chars", (F.col("lang") == "en").alias("Y"))
    paths = write_matrix_csv(src, _scratch(spark, "csv-quoted"))
    fr = read_matrix(spark, paths, target="Y", carry=["doc_id", "text"])
    key = F.col("doc_id").cast("long").alias("doc_id")
    return fr.df.select(key, F.md5("text").alias("text_md5"), "label", F.col("f_0").alias("n_chars"))


def q_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a header repeats: suppliers counted per nation, each column under its region's name."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    header = nations.select("n_nationkey", "r_name").orderBy("n_nationkey").collect()  # one row per nation
    counts = [F.count_if(F.col("s_nationkey") == r["n_nationkey"]).alias(f"c{i}") for i, r in enumerate(header)]
    src = table(spark, sf_dir, "supplier").agg(*counts)
    paths = write_matrix_csv(src, _scratch(spark, "dup-names"), header=[r["r_name"] for r in header])
    return duplicate_columns(spark, paths)


def q_constant_flags_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed profile of the embedding dimensions, every third one NULL in most rows."""
    emb = table(spark, sf_dir, "embeddings")
    holes = F.transform("embedding", lambda x, i: F.when((i % 3 != 0) | (F.col("vec_id") == 0), x.cast("double")))
    names = [f"e{i}" for i in range(emb.select(F.max(F.size("embedding")).alias("d")).first()["d"])]
    fr = FeatureFrame.from_array(emb.select(holes.alias("v"), "vec_id"), "v", names)
    return constant_feature_flags(fr)


def q_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_counts(_scored_fixed(spark, sf_dir))


def _keyed_lineitem_csv(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    flag = F.when(F.col("l_quantity") > 25, F.lit("true")).otherwise(F.lit("false"))
    src = li.select(
        key.alias("row_key"),
        (F.col("l_quantity") - F.lit(25.5)).alias("q"),
        "l_tax",
        "l_discount",
        flag.alias("Y"),
    )
    return write_matrix_csv(src, _scratch(spark, name))


def q_predictions_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _keyed_lineitem_csv(spark, sf_dir, "keyed-csv")
    model_path = LINEITEM_MODEL.save(spark, _scratch(spark, "keyed-model"))
    indexed = predict(spark, paths, model_path, row_labels="row_key")
    return keyed_predictions(indexed, ["row_key"])


def q_predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written prediction files as text, keyed by a column that is called ``index``."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *LINEITEM_KEYS).alias("index")
    src = li.select(key, (F.col("l_quantity") - F.lit(25.5)).alias("q"), "l_tax", "l_discount")
    paths = write_matrix_csv(src, _scratch(spark, "file-csv"))
    model_path = LINEITEM_MODEL.save(spark, _scratch(spark, "file-model"))
    out = _scratch(spark, "file-predictions")
    predict(spark, paths, model_path, out=out, target=None, row_labels="index")
    return spark.read.text(out).where(F.col("value") != PREDICTION_HEADER).withColumnRenamed("value", "line")


def q_predictions_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row index over a column of two values: where each value's rows begin and end."""
    indexed = with_row_index(table(spark, sf_dir, "lineitem"), ["l_linestatus"])
    places = [F.min("index").alias("first"), F.max("index").alias("last"), F.count(F.lit(1)).alias("n")]
    return indexed.groupBy("l_linestatus").agg(*places, F.sum("index").alias("total"))


def q_predictions_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(events_frame(spark, sf_dir), EVENTS_MODEL)
    return prediction_lines(with_row_index(scored, ["event_id"]))


def q_predictions_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "purchase", F.lit("true")).otherwise(F.lit("false"))
    src = ev.orderBy("event_id").select("event_id", "user_id", "value", flag.alias("Y"))
    paths = write_matrix_csv(src, _scratch(spark, "events-csv"), keep_order=True)
    model_path = EVENTS_MODEL.save(spark, _scratch(spark, "events-model"))
    indexed = predict(spark, paths, model_path, ignore="event_id")
    return prediction_lines(indexed)


def q_train_logistic_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = learn_frame(spark, sf_dir)
    model = fit_logistic_l1(fr, reg_param=LEARN_REG_PARAM)
    return score(fr, model).select(*LINEITEM_KEYS, "prediction")


def q_train_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training job, from CSV text to the stored weights; one 0/1 feature per return flag."""
    li = table(spark, sf_dir, "lineitem")
    least = F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "N", 10).otherwise(25)
    flags = [(F.col("l_returnflag") == v).alias(v) for v in ("A", "N", "R")]
    paths = write_matrix_csv(li.select(*flags, (F.col("l_quantity") > least).alias("Y")), _scratch(spark, "train-csv"))
    out = _scratch(spark, "train-model")
    train(spark, paths, out, reg_param=TRAIN_JOB_REG_PARAM)
    return weights_long(read_model_df(spark, out)).select("idx", "name", rounded("value", 3).alias("value"))


def q_train_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 least squares without an intercept."""
    fr = FeatureFrame.from_columns(table(spark, sf_dir, "lineitem"), ["l_quantity"], label="l_extendedprice")
    model = fit_linear(fr, reg_param=LASSO_REG_PARAM)
    return model.weights_df(spark).select("name", rounded("value", 2).alias("value"))


def q_train_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fr = FeatureFrame.from_columns(li, ["l_quantity"], label="l_extendedprice")
    model = fit_linear(fr, reg_param=0.0, fit_intercept=True, solver="normal")
    row = spark.createDataFrame([(model.weights[0], model.intercept)], "slope DOUBLE, intercept DOUBLE")
    return row.select(rounded("slope", 3).alias("slope"), rounded("intercept", 3).alias("intercept"))


def q_train_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lasso of scaled features, folded, stored, loaded, and applied to raw rows of another table."""
    fr = FeatureFrame.from_columns(table(spark, sf_dir, "lineitem"), {"size": "l_quantity"}, label="l_extendedprice")
    scaler = Scaler.fit(fr)
    scaled = fit_linear(scaler.apply(fr), reg_param=LASSO_REG_PARAM, fit_intercept=True, standardization=False)
    path = scaler.fold(scaled).save(spark, _scratch(spark, "scaled-model"))
    raw = FeatureFrame.from_columns(table(spark, sf_dir, "part"), {"size": "p_size"}, carry=["p_partkey"])
    return score(raw, load_model(spark, path)).select("p_partkey", rounded("prediction", 2).alias("prediction"))


def q_model_weight_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = weight_ranking(centroid_weights(spark, sf_dir))
    return ranking.select(F.col("rank").cast("long").alias("rank"), "idx", "name", "value", "line")


def q_model_zero_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zero_weight_summary(centroid_weights(spark, sf_dir))
    return z.select("zero", "total", rounded("percent").alias("percent"))


def q_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_from_weights(centroid_weights(spark, sf_dir))
    path = model.save(spark, _scratch(spark, "model"))
    return weights_long(read_model_df(spark, path))


def _wide_part_model(spark: SparkSession, sf_dir: str) -> WideModel:
    """One weight per part, how its mean quantity differs from 25.5; stored and loaded."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"))
    name = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name")
    weights = parts.select(F.col("l_partkey").alias("idx"), name, (F.floor(F.col("q") * 4) - 102).cast("double").alias("value"))
    return load_wide_model(spark, WideModel(weights, -3.0, "linear").save(_scratch(spark, "wide-model")))


def q_model_wide_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of a model whose weights never reach the driver."""
    return weight_ranking(_wide_part_model(spark, sf_dir).weights)


def q_score_wide_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored from (order, part, quantity) rows by a model with a weight per part."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name")
    entries = li.select("l_orderkey", name, F.col("l_quantity").alias("value"))
    return score_entries(entries, _wide_part_model(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "prediction")


def q_model_missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    dim = emb.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    keep = dim * 3 // 4
    frame = FeatureFrame.from_columns(emb, {f"e{i}": F.col("embedding")[i] for i in range(keep)})
    have = spark.createDataFrame([(n,) for n in frame.feature_names], "name STRING")
    return missing_feature_names(centroid_weights(spark, sf_dir), have)


def q_model_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = learn_frame(spark, sf_dir)
    model = fit_logistic_l1(fr, reg_param=LEARN_REG_PARAM, arguments=("--reg-param=0.1",))
    path = model.save(spark, _scratch(spark, "prov-model"))
    stored = read_model_df(spark, path)
    return stored.select(
        *[F.col(f"provenance.{c}").isNotNull().alias(f"has_{c}") for c in ("user", "host", "timestamp")],
        F.array_join("provenance.arguments", " ").alias("arguments"),
        F.col("provenance.attributes")["kind"].alias("kind"),
        F.size("weights").alias("n_weights"),
    )


def q_truncated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    return truncated_listing(cu, ["c_nationkey"], "c_custkey", "c_name", LISTING_BUDGET)


def q_truncated_listing_unseparated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without a separator, some empty, in groups of a fifth of all rows each."""
    piece = F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).otherwise(F.lit(""))
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", piece.alias("piece"))
    return truncated_listing(ev, ["event_type"], "event_id", "piece", LISTING_BUDGET, separator="")


def q_observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(events_frame(spark, sf_dir), EVENTS_MODEL)
    observed, obs = observe_counters(
        scored,
        "scoring",
        rows=F.count(F.lit(1)),
        purchases=F.count_if(F.col(LABEL) == 1.0),
        predicted_positive=F.count_if(F.col("prediction") == 1.0),
    )
    observed.write.format("noop").mode("overwrite").save()
    m = obs.get
    return spark.createDataFrame(
        [(m["rows"], m["purchases"], m["predicted_positive"])], "rows BIGINT, purchases BIGINT, predicted_positive BIGINT"
    )


def q_score_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed layout: embeddings scored with the centroid model (array fold)."""
    emb = table(spark, sf_dir, "embeddings")
    model = model_from_weights(centroid_weights(spark, sf_dir))
    frame = FeatureFrame.from_array(emb, "embedding", model.names, label=(F.col("label") >= 5), carry=["vec_id"])
    scored = score(frame, model)
    return scored.select("vec_id", rounded("margin").alias("margin"), "prediction")


def q_csv_packed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed CSV parse: embeddings as 64 text columns, read back as one array."""
    emb = table(spark, sf_dir, "embeddings")
    dim = emb.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    flag = F.when(F.col("label") >= 5, F.lit("true")).otherwise(F.lit("false"))
    src = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dim)], flag.alias("Y"))
    paths = write_matrix_csv(src, _scratch(spark, "packed-csv"))
    fr = read_matrix(spark, paths, target="Y", packed=True)
    total = F.aggregate(fr.feature_array(), F.lit(0.0), lambda acc, x: acc + x)
    return fr.df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum(total), 4).alias("sum_all"),
        rounded(F.sum(fr.feature_col(dim - 1)), 6).alias("sum_last"),
    )


def q_stream_keyed_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _keyed_lineitem_csv(spark, sf_dir, "stream-in")
    header = ["row_key", "q", "l_tax", "l_discount", "Y"]
    frame = read_matrix_stream(spark, paths[1], header, target="Y", carry=["row_key"])
    out = _scratch(spark, "stream-out")
    query = start_keyed_scoring(frame, LINEITEM_MODEL, ["row_key"], out)
    query.awaitTermination()  # an availableNow run ends by itself
    if query.exception() is not None:
        raise RuntimeError(f"streaming scoring failed: {query.exception()}")
    return spark.read.schema("row_key STRING, prediction DOUBLE").parquet(out)


def q_stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without a prediction, added up over the micro-batches of a stream of several files."""
    ev = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    src = ev.select("event_id", text.alias("value"), "user_id", (F.col("event_type") == "purchase").alias("Y"))
    paths = write_matrix_csv(src.repartition(3, "event_id"), _scratch(spark, "counted-in"))
    header = ["event_id", "value", "user_id", "Y"]
    frame = read_matrix_stream(
        spark, paths[1], header, carry=["event_id"], on_error="null", max_files_per_trigger=1
    )
    query = start_keyed_scoring(frame, EVENTS_MODEL, ["event_id"], _scratch(spark, "counted-out"))
    query.awaitTermination()  # an availableNow run ends by itself
    if query.exception() is not None:
        raise RuntimeError(f"streaming scoring failed: {query.exception()}")
    batches = ScoringCounters().update(query).to_df(spark)
    return batches.agg(F.sum("scored").alias("scored"), F.sum("unscored").alias("unscored"), (F.count("*") > 1).alias("in_batches"))


QUERIES: dict[str, Query] = {
    "csv_scan": q_csv_scan,
    "csv_header": q_csv_header,
    "duplicate_columns": q_duplicate_columns,
    "header_rows_removed": q_header_rows_removed,
    "lenient_numeric": q_lenient_numeric,
    "boolean_as_number": q_boolean_as_number,
    "label_select": q_label_select,
    "unlabelled_select": q_unlabelled_select,
    "feature_select": q_feature_select,
    "feature_select_first_n": q_feature_select_first_n,
    "project_by_name": q_project_by_name,
    "project_by_index": q_project_by_index,
    "transform_rows": q_transform_rows,
    "matrix_shape": q_matrix_shape,
    "label_distribution": q_label_distribution,
    "label_positive_rate": q_label_positive_rate,
    "constant_feature_flags": q_constant_feature_flags,
    "drop_constant_features": q_drop_constant_features,
    "standardize_features": q_standardize_features,
    "score_margin": q_score_margin,
    "score_probability": q_score_probability,
    "score_class": q_score_class,
    "score_accuracy": q_score_accuracy,
    "score_with_missing": q_score_with_missing,
    "csv_quoted_scan": q_csv_quoted_scan,
    "duplicate_names": q_duplicate_names,
    "constant_flags_with_missing": q_constant_flags_with_missing,
    "confusion_counts": q_confusion_counts,
    "predictions_keyed": q_predictions_keyed,
    "predictions_file": q_predictions_file,
    "predictions_two_keys": q_predictions_two_keys,
    "predictions_indexed": q_predictions_indexed,
    "predictions_input_order": q_predictions_input_order,
    "train_logistic_l1": q_train_logistic_l1,
    "train_job": q_train_job,
    "train_lasso": q_train_lasso,
    "train_linear": q_train_linear,
    "train_scaled": q_train_scaled,
    "model_wide_ranking": q_model_wide_ranking,
    "score_wide_entries": q_score_wide_entries,
    "model_weight_ranking": q_model_weight_ranking,
    "model_zero_weights": q_model_zero_weights,
    "model_roundtrip": q_model_roundtrip,
    "model_missing_features": q_model_missing_features,
    "model_provenance": q_model_provenance,
    "truncated_listing": q_truncated_listing,
    "truncated_listing_unseparated": q_truncated_listing_unseparated,
    "stream_counters": q_stream_counters,
    "observed_counters": q_observed_counters,
    "stream_keyed_scoring": q_stream_keyed_scoring,
    "score_packed": q_score_packed,
    "csv_packed_scan": q_csv_packed_scan,
}


# ------------------------------------------------------------------- oracle
def _flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"


D = "CAST({} AS DOUBLE)".format
LI_MARGIN = (
    "((((l_quantity - 25.5) * CAST(0.08 AS DOUBLE)) + (l_discount * CAST(-3.0 AS DOUBLE)))"
    " + (l_tax * CAST(5.0 AS DOUBLE))) + CAST(-0.1 AS DOUBLE)"
)
EV_MARGIN = "((value * CAST(0.01 AS DOUBLE)) + (CAST(user_id AS DOUBLE) * CAST(-0.02 AS DOUBLE))) + CAST(0.5 AS DOUBLE)"


def _prob(m: str) -> str:
    return f"(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({m}))))"


def _cls(m: str) -> str:
    return f"CAST(CASE WHEN {_prob(m)} > 0.5 THEN 1 ELSE 0 END AS DOUBLE)"


CENTROID_SQL = """
WITH e AS (
  SELECT label >= 5 AS pos, unnest(range(len(embedding))) AS idx, unnest(embedding) AS v FROM embeddings
)
SELECT CAST(idx AS INTEGER) AS idx, 'e' || CAST(idx AS VARCHAR) AS name,
       round(avg(CASE WHEN pos THEN v END) - avg(CASE WHEN NOT pos THEN v END), 2) + 0.0 AS value
FROM e GROUP BY idx
"""

_CONST_COLS = [
    ("l_quantity", "l_quantity"),
    ("one", "CAST(1.0 AS DOUBLE)"),
    ("nan_some", "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"),
    ("nan_all", "CAST('NaN' AS DOUBLE)"),
    ("signed_zero", "CASE WHEN l_orderkey % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE -CAST(0.0 AS DOUBLE) END"),
    ("l_tax", "l_tax"),
]


def _constant_flags_sql() -> str:
    cols = ", ".join(f"{expr} AS c{i}" for i, (_, expr) in enumerate(_CONST_COLS))
    parts = []
    for i, (name, _) in enumerate(_CONST_COLS):
        varies = f"(min(c{i}) <> max(c{i}) OR (count(*) FILTER (WHERE isnan(c{i})) > 0 AND count(*) >= 2))"
        parts.append(f"SELECT {i} AS position, '{name}' AS name, NOT {varies} AS is_constant FROM t")
    return f"WITH t AS (SELECT {cols} FROM lineitem) " + " UNION ALL ".join(parts)


def _standardize_sql() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    outs = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in cols)
    return (
        f"WITH s AS (SELECT {stats} FROM lineitem) "
        f"SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS label, {outs} FROM lineitem, s"
    )


def _csv_header_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, count({c}) AS non_empty FROM orders" for i, c in enumerate(cols)
    )


def _indexed_sql() -> str:
    return (
        "SELECT index, printf('%d, %f', index, prediction) AS line FROM ("
        f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS index, {_cls(EV_MARGIN)} AS prediction FROM events)"
    )


ORACLE_SQL: dict[str, str] = {
    "csv_scan": (
        f"SELECT {_flag("l_returnflag = 'R'")} AS label, count(*) AS n, "
        "round(sum(l_quantity), 2) + 0.0 AS sum_quantity, round(sum(l_extendedprice), 2) + 0.0 AS sum_extendedprice, "
        "round(sum(l_discount), 2) + 0.0 AS sum_discount, round(sum(l_tax), 2) + 0.0 AS sum_tax "
        "FROM lineitem GROUP BY 1"
    ),
    "csv_header": _csv_header_sql(),
    "duplicate_columns": (
        f"SELECT {_flag("l_linestatus = 'O'")} AS label, l_quantity AS f_0, l_tax AS f_1, l_quantity AS f_2 "
        "FROM lineitem"
    ),
    "header_rows_removed": (
        f"SELECT {_flag("c_mktsegment = 'BUILDING'")} AS label, {D('c_custkey')} AS c_custkey, "
        f"{D('c_nationkey')} AS c_nationkey, c_acctbal FROM customer"
    ),
    "lenient_numeric": (
        "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 "
        "WHEN 'purchase' THEN floor(value) ELSE value END AS DOUBLE) AS x FROM events"
    ),
    "boolean_as_number": f"SELECT o_orderkey, {_flag("o_orderstatus = 'F'")} AS x FROM orders",
    "label_select": f"SELECT doc_id, {D('quality')} AS label, {D('toxic')} AS toxic FROM labels",
    "unlabelled_select": (
        "SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS label, l_quantity, l_extendedprice, l_discount, l_tax "
        "FROM lineitem"
    ),
    "feature_select": (
        f"SELECT l_orderkey, l_linenumber, l_tax AS label, {D('l_suppkey')} AS l_suppkey, l_quantity, "
        "l_extendedprice, l_discount FROM lineitem"
    ),
    "feature_select_first_n": (
        f"SELECT l_orderkey, l_linenumber, l_tax AS label, {D('l_suppkey')} AS l_suppkey, l_quantity FROM lineitem"
    ),
    "project_by_name": (
        "SELECT l_orderkey, l_linenumber, l_discount AS label, l_tax AS f_0, l_quantity AS f_1, l_tax AS f_2 "
        "FROM lineitem"
    ),
    "project_by_index": "SELECT l_orderkey, l_linenumber, l_discount AS label, l_tax, l_quantity FROM lineitem",
    "transform_rows": (
        f"SELECT o_orderkey, {_flag("o_orderstatus = 'F'")} AS label, "
        "round(ln(1 + o_totalprice), 6) + 0.0 AS o_totalprice, round(sqrt(o_custkey), 6) + 0.0 AS o_custkey "
        "FROM orders"
    ),
    "matrix_shape": "SELECT count(*) AS rows, 4 AS features FROM lineitem",
    "label_distribution": f"SELECT {D('quality')} AS label, count(*) AS n FROM labels GROUP BY 1",
    "label_positive_rate": (
        "SELECT count(*) FILTER (WHERE l_quantity > 25) AS positives, count(*) AS total, "
        "round(CAST(count(*) FILTER (WHERE l_quantity > 25) AS DOUBLE) * 100.0 / count(*), 6) + 0.0 AS percent "
        "FROM lineitem"
    ),
    "constant_feature_flags": _constant_flags_sql(),
    "drop_constant_features": (
        f"SELECT l_orderkey, l_linenumber, {_flag('l_quantity > 25')} AS label, l_quantity, "
        f"{_CONST_COLS[2][1]} AS nan_some, {_CONST_COLS[3][1]} AS nan_all, l_tax FROM lineitem"
    ),
    "standardize_features": _standardize_sql(),
    "score_margin": f"SELECT l_orderkey, l_linenumber, round({LI_MARGIN}, 6) + 0.0 AS margin FROM lineitem",
    "score_probability": (
        f"SELECT l_orderkey, l_linenumber, round({_prob(LI_MARGIN)}, 6) + 0.0 AS probability FROM lineitem"
    ),
    "score_class": f"SELECT l_orderkey, l_linenumber, {_cls(LI_MARGIN)} AS prediction FROM lineitem",
    "score_with_missing": (
        "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, "
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN 0.01 * value - 0.02 * user_id + 0.5 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE "
        "AS prediction FROM events"
    ),
    "csv_quoted_scan": (
        "SELECT doc_id, md5(trim('\"' || chr(92) || regexp_replace(text, '[\\r\\n]+', ' ', 'g') || ',' || chr(92) || '\"')) "
        "AS text_md5, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, n_chars::DOUBLE AS n_chars FROM documents"
    ),
    "duplicate_names": (
        "SELECT r_name AS name, count(*) AS occurrences FROM nation JOIN region ON r_regionkey = n_regionkey "
        "GROUP BY 1 HAVING count(*) > 1"
    ),
    "constant_flags_with_missing": (
        "SELECT position, 'e' || position AS name, "
        "count(DISTINCT CASE WHEN position % 3 <> 0 OR vec_id = 0 THEN v END) < 2 AS is_constant "
        "FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, "
        "(generate_subscripts(embedding, 1) - 1)::INTEGER AS position FROM embeddings) GROUP BY position"
    ),
    "score_accuracy": (
        "SELECT count(*) AS rows, count(*) FILTER (WHERE label = prediction) AS correct, "
        "count(*) FILTER (WHERE prediction IS NULL) AS unscored, "
        "round(CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / count(*), 6) + 0.0 AS accuracy "
        f"FROM (SELECT {_flag('l_quantity > 25')} AS label, {_cls(LI_MARGIN)} AS prediction FROM lineitem)"
    ),
    "confusion_counts": (
        f"SELECT {_flag('l_quantity > 25')} AS label, {_cls(LI_MARGIN)} AS prediction, count(*) AS n "
        "FROM lineitem GROUP BY 1, 2"
    ),
    "predictions_keyed": (
        "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_key, "
        f"{_cls(LI_MARGIN)} AS prediction FROM lineitem"
    ),
    "predictions_file": (
        "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || "
        f"printf(', %f', {_cls(LI_MARGIN)}) AS line FROM lineitem"
    ),
    "predictions_two_keys": (
        'SELECT l_linestatus, min(i) AS "first", max(i) AS "last", count(*) AS n, CAST(sum(i) AS BIGINT) AS total '
        "FROM (SELECT l_linestatus, row_number() OVER (ORDER BY l_linestatus) - 1 AS i FROM lineitem) GROUP BY 1"
    ),
    "predictions_indexed": _indexed_sql(),
    "predictions_input_order": _indexed_sql(),
    "train_logistic_l1": (
        f"SELECT l_orderkey, l_linenumber, {_flag('l_quantity > 25.5')} AS prediction FROM lineitem"
    ),
    # one 0/1 feature a group: the L1 optimum moves each group's share of ones towards a half
    "train_job": (
        "WITH g AS (SELECT l_returnflag AS name, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN l_quantity > "
        "CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 10 ELSE 25 END THEN 1.0 ELSE 0.0 END) AS p "
        "FROM lineitem GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM lineitem), "
        "m AS (SELECT name, p, sqrt(n / total * (1 - n / total) * total / (total - 1)) * total / n "
        f"* {TRAIN_JOB_REG_PARAM} AS shift FROM g, t), "
        "q AS (SELECT name, CASE WHEN p > 0.5 THEN greatest(p - shift, 0.5) ELSE least(p + shift, 0.5) END AS s FROM m) "
        "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx, name, round(ln(s / (1 - s)), 3) + 0.0 AS value FROM q"
    ),
    "train_lasso": (
        "SELECT 'l_quantity' AS name, round(greatest(avg(l_quantity * l_extendedprice) - "
        f"{LASSO_REG_PARAM} * stddev_samp(l_quantity), 0) / avg(l_quantity * l_quantity), 2) + 0.0 AS value FROM lineitem"
    ),
    "train_linear": (
        "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope, "
        "round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept FROM lineitem"
    ),
    "model_weight_ranking": (
        f"WITH w AS ({CENTROID_SQL}) SELECT row_number() OVER (ORDER BY abs(value) DESC, idx) AS rank, "
        "idx, name, value, printf(' [%10d] %20s = %.15f', idx, name, value) AS line FROM w WHERE value <> 0"
    ),
    "model_zero_weights": (
        f"WITH w AS ({CENTROID_SQL}) SELECT count(*) FILTER (WHERE value = 0) AS zero, count(*) AS total, "
        "round(CAST(count(*) FILTER (WHERE value = 0) AS DOUBLE) * 100.0 / count(*), 6) + 0.0 AS percent FROM w"
    ),
    "model_roundtrip": f"WITH w AS ({CENTROID_SQL}) SELECT idx, name, value FROM w",
    "model_provenance": (
        "SELECT true AS has_user, true AS has_host, true AS has_timestamp, '--reg-param=0.1' AS arguments, "
        "'logistic' AS kind, 3 AS n_weights"
    ),
    "model_missing_features": (
        f"WITH w AS ({CENTROID_SQL}) SELECT name, idx FROM w "
        "WHERE idx >= (SELECT max(len(embedding)) * 3 // 4 FROM embeddings)"
    ),
    "truncated_listing": f"""
WITH w AS (
  SELECT c_nationkey, c_custkey, c_name,
         {LISTING_BUDGET} - coalesce(sum(length(c_name) + 1) OVER (
             PARTITION BY c_nationkey ORDER BY c_custkey, c_name
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 6 AS keep
  FROM customer
)
SELECT c_nationkey,
       coalesce(string_agg(c_name, ',' ORDER BY c_custkey, c_name) FILTER (WHERE keep), '') ||
       CASE WHEN count(*) > count(*) FILTER (WHERE keep)
            THEN CASE WHEN count(*) FILTER (WHERE keep) > 0 THEN ', [...]' ELSE ' [...]' END
            ELSE '' END AS listing
FROM w GROUP BY c_nationkey
""",
    "observed_counters": (
        "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, "
        f"count(*) FILTER (WHERE {_prob(EV_MARGIN)} > 0.5) AS predicted_positive FROM events"
    ),
    "stream_keyed_scoring": (
        "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_key, "
        f"{_cls(LI_MARGIN)} AS prediction FROM lineitem"
    ),
}

ORACLE_SQL["score_packed"] = f"""
WITH w AS ({CENTROID_SQL}),
m AS (
  SELECT e.vec_id, any_value(e.label) AS label, sum(CAST(e.v AS DOUBLE) * w.value) AS margin
  FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS idx, unnest(embedding) AS v FROM embeddings) e
  JOIN w ON w.idx = e.idx
  GROUP BY e.vec_id
)
SELECT vec_id, round(margin, 6) + 0.0 AS margin, {_cls('margin')} AS prediction FROM m
"""
ORACLE_SQL["csv_packed_scan"] = """
SELECT CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS DOUBLE) AS label, count(*) AS n,
       round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) + 0.0 AS sum_all,
       round(sum(CAST(embedding[len(embedding)] AS DOUBLE)), 6) + 0.0 AS sum_last
FROM embeddings GROUP BY 1
"""
# centred by its mean, the feature leaves the label's mean to the intercept, and the L1 optimum shrinks its covariance
ORACLE_SQL["train_scaled"] = f"""
WITH t AS (
  SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, covar_pop(l_quantity, l_extendedprice) AS c,
         avg(l_extendedprice) AS b, count(*) AS n FROM lineitem
), w AS (
  SELECT m, s, b, greatest(c / s - {LASSO_REG_PARAM}, 0) * n / (n - 1) AS w FROM t
)
SELECT p_partkey, round(w * (p_size - m) / s + b, 2) + 0.0 AS prediction FROM part, w
"""
PART_WEIGHTS_SQL = """
  SELECT l_partkey AS idx, 'part-' || l_partkey AS name, (floor(avg(l_quantity) * 4) - 102)::DOUBLE AS value
  FROM lineitem GROUP BY l_partkey
"""
ORACLE_SQL["model_wide_ranking"] = f"""
WITH w AS ({PART_WEIGHTS_SQL})
SELECT row_number() OVER (ORDER BY abs(value) DESC, idx) AS rank, idx, name, value,
       printf(' [%10d] %20s = %.15f', idx, name, value) AS line FROM w WHERE value <> 0
"""
ORACLE_SQL["score_wide_entries"] = f"""
WITH w AS ({PART_WEIGHTS_SQL})
SELECT l_orderkey, sum(value * l_quantity) - 3.0 AS prediction FROM lineitem JOIN w ON idx = l_partkey GROUP BY 1
"""
ORACLE_SQL["truncated_listing_unseparated"] = f"""
WITH p AS (
  SELECT event_type, event_id, CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR ELSE '' END AS piece FROM events
), w AS (
  SELECT *, {LISTING_BUDGET} - coalesce(sum(length(piece)) OVER (
    PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 6 AS keep FROM p
)
SELECT event_type, coalesce(string_agg(piece, '' ORDER BY event_id) FILTER (WHERE keep), '') ||
       CASE WHEN bool_and(keep) THEN '' ELSE ' [...]' END AS listing
FROM w GROUP BY event_type
"""
ORACLE_SQL["stream_counters"] = (
    "SELECT count(*) FILTER (WHERE event_id % 7 <> 0) AS scored, count(*) FILTER (WHERE event_id % 7 = 0) AS unscored, "
    "true AS in_batches FROM events"
)
