"""Model store, report (FIXTURES.md section 4), scoring alignment."""

import pytest

from glmframe.frame import FeatureFrame
from glmframe.operators.model_report import missing_feature_names, weight_ranking, zero_weight_summary
from glmframe.operators.scoring import align, score
from glmframe.sources.model_store import LinearModel, load_model, read_model_df, weights_long

MODEL = LinearModel(("a", "b", "c", "d", "e"), (0.5, 0.0, -2.0, 0.5, 0.0), 0.25)


def test_ranking_and_zero_summary(spark):
    w = MODEL.weights_df(spark)
    ranking = [tuple(r) for r in weight_ranking(w).orderBy("rank").select("rank", "idx", "name").collect()]
    assert ranking == [(1, 2, "c"), (2, 0, "a"), (3, 3, "d")]
    line = weight_ranking(w).orderBy("rank").first()["line"]
    assert line == " [         2]                    c = -2.000000000000000"
    assert tuple(zero_weight_summary(w).first()) == (2, 5, 40.0)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_roundtrip(spark, tmp_path, fmt):
    path = str(tmp_path / f"m.{fmt}")
    MODEL.save(spark, path, fmt=fmt)
    back = load_model(spark, path, fmt=fmt)
    assert back.names == MODEL.names and back.weights == MODEL.weights and back.intercept == 0.25
    assert back.kind == "logistic"
    long = sorted(tuple(r) for r in weights_long(read_model_df(spark, path, fmt)).collect())
    assert long == [(i, n, v) for i, (n, v) in enumerate(zip(MODEL.names, MODEL.weights))]
    MODEL.save(spark, path, fmt=fmt)  # overwrites
    assert load_model(spark, path, fmt=fmt) == back


def test_provenance(spark, tmp_path):
    path = str(tmp_path / "p")
    LinearModel(("x",), (1.0,), kind="linear", arguments=("--input=a",)).save(spark, path)
    prov = read_model_df(spark, path).first()["provenance"]
    assert prov["user"] and prov["host"] and prov["timestamp"]
    assert list(prov["arguments"]) == ["--input=a"]
    assert prov["attributes"]["kind"] == "linear"
    assert load_model(spark, path).kind == "linear"


def test_length_mismatch_rejected():
    with pytest.raises(ValueError):
        LinearModel(("a",), (1.0, 2.0))


def test_alignment_by_name_and_position(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0)], "b DOUBLE, a DOUBLE, z DOUBLE, label DOUBLE")
    fr = FeatureFrame.from_columns(df, ["b", "a", "z"], label="label")
    m = LinearModel(("a", "b"), (1.0, 10.0), 0.5)
    assert align(fr, m).feature_names == ("a", "b")
    assert score(fr, m).first()["margin"] == 2.0 * 1.0 + 1.0 * 10.0 + 0.5
    with pytest.raises(ValueError):
        score(fr, m, align_mode="position")
    with pytest.raises(KeyError, match="missing"):
        score(fr, LinearModel(("a", "q"), (1.0, 1.0)))
    have = spark.createDataFrame([("a",), ("z",)], "name STRING")
    missing = [tuple(r) for r in missing_feature_names(m.weights_df(spark), have).collect()]
    assert missing == [("b", 1)]


def test_logistic_threshold_and_linear(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0)], "x DOUBLE, label DOUBLE")
    fr = FeatureFrame.from_columns(df, ["x"], label="label")
    got = {r["margin"]: (r["probability"], r["prediction"]) for r in score(fr, LinearModel(("x",), (2.0,))).collect()}
    assert got[0.0] == (0.5, 0.0)  # p = 0.5 is not above the threshold
    assert got[2.0][1] == 1.0 and got[-2.0][1] == 0.0
    lin = {r["margin"]: r["prediction"] for r in score(fr, LinearModel(("x",), (2.0,), 1.0, "linear")).collect()}
    assert lin == {1.0: 1.0, 3.0: 3.0, -1.0: -1.0}


def test_nan_feature_propagates_even_with_zero_weight(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, 0.0)], "x DOUBLE, y DOUBLE, label DOUBLE")
    fr = FeatureFrame.from_columns(df, ["x", "y"], label="label")
    r = score(fr, LinearModel(("x", "y"), (0.0, 5.0))).first()
    assert r["margin"] != r["margin"] and r["prediction"] == 0.0


def test_format_from_extension(spark, tmp_path):
    path = str(tmp_path / "model.json")
    MODEL.save(spark, path)
    assert spark.read.json(path).count() == 1  # really JSON
    assert load_model(spark, path).weights == MODEL.weights


def test_dotted_column_names(spark):
    from glmframe.operators.row_index import with_row_index
    from glmframe.operators.scoring import keyed_predictions

    df = spark.createDataFrame([(i, float(i) - 2.0, float(i % 2)) for i in range(5)], "`k.id` INT, `x.v` DOUBLE, `y.t` DOUBLE")
    fr = FeatureFrame.from_table(df, target="y.t", carry=["k.id"])
    assert fr.feature_names == ("x.v",)
    scored = score(fr, LinearModel(("x.v",), (1.0,)))
    keyed = sorted(tuple(r) for r in keyed_predictions(scored, ["k.id"]).collect())
    assert keyed == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)]
    idx = sorted((r["k.id"], r["index"]) for r in with_row_index(scored, ["k.id"], rows_per_bucket=1).collect())
    assert idx == [(i, i) for i in range(5)]
    assert fr.to_df().columns == ["label", "x.v", "k.id"]
