"""Scaling kept with the model: fit, apply elsewhere, fold, store."""

import math

import pytest
from pyspark.sql import functions as F

from glmframe.frame import FeatureFrame
from glmframe.operators.scaling import Scaler, standardize
from glmframe.operators.scoring import score
from glmframe.operators.train import fit_logistic_l1
from glmframe.plans.commands import train
from glmframe.sources.csv_matrix import write_matrix_csv
from glmframe.sources.model_store import LinearModel, Scaling, load_model, read_model_df


def frame_of(spark, rows, packed=False):
    df = spark.createDataFrame(rows, "y DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE")
    return FeatureFrame.from_columns(df, ["a", "b", "c"], label="y", packed=packed)


ROWS = [(0.0, 1.0, 100.0, 7.0), (1.0, 2.0, 300.0, 7.0), (0.0, None, 500.0, 7.0), (1.0, 6.0, 100.0, None)]


@pytest.mark.parametrize("packed", [False, True])
def test_null_stays_null_and_constant_becomes_zero(spark, packed):
    out = standardize(frame_of(spark, ROWS, packed)).to_wide().df.select("f_0", "f_1", "f_2").collect()
    assert [r["f_2"] for r in out] == [0.0, 0.0, 0.0, None]
    assert out[2]["f_0"] is None
    assert [r["f_0"] for r in out][:2] == pytest.approx([-2 / math.sqrt(7), -1 / math.sqrt(7)])


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("center, scale", [(True, True), (True, False), (False, True)])
def test_folded_model_scores_raw_rows_alike(spark, packed, center, scale):
    scaler = Scaler.fit(frame_of(spark, ROWS, packed), center, scale)
    other = frame_of(spark, [(0.0, 3.0, -4.0, 9.0), (1.0, 0.5, 2.0, 7.0), (1.0, None, 1.0, 7.0)], packed)
    model = LinearModel(("a", "b", "c"), (2.0, -30.0, 5.0), 0.25)
    folded = scaler.fold(model)
    # c has no deviation: scaled it is 0.0 whatever it holds
    want = [r["margin"] for r in score(scaler.apply(other), model).collect()]
    got = [r["margin"] for r in score(other, folded).collect()]
    assert got[2] is want[2] is None
    assert got[:2] == pytest.approx(want[:2], rel=1e-12)


def test_fold_and_unfold(spark):
    scaler = Scaler(("a", "b"), (3.0, 0.0), (2.0, 0.5))
    model = LinearModel(("a", "b"), (4.0, -1.0), 1.0, "linear", ("--x",))
    folded = scaler.fold(model)
    assert folded.weights == (2.0, -2.0) and folded.intercept == -5.0 and folded.kind == "linear"
    assert folded.scaling == (Scaling(3.0, 2.0), Scaling(0.0, 0.5))
    assert Scaler.unfold(folded) == model and Scaler.of(folded) == scaler and Scaler.of(model) is None
    with pytest.raises(ValueError, match="aren't those"):
        scaler.fold(LinearModel(("b", "a"), (1.0, 1.0)))
    with pytest.raises(ValueError, match="aren't those"):
        scaler.apply(frame_of(spark, ROWS))
    with pytest.raises(ValueError, match="not folded"):
        Scaler.unfold(model)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_moments_are_stored_with_the_model(spark, tmp_path, fmt):
    model = Scaler(("a", "b"), (3.0, 0.0), (2.0, 0.0)).fold(LinearModel(("a", "b"), (4.0, -1.0), 1.0))
    path = model.save(spark, str(tmp_path / f"m.{fmt}"), fmt)
    assert load_model(spark, path, fmt) == model
    assert read_model_df(spark, path, fmt).columns == ["provenance", "intercept", "weights"]
    plain = LinearModel(("a",), (1.0,))
    assert load_model(spark, plain.save(spark, str(tmp_path / f"p.{fmt}"), fmt), fmt).scaling is None


def test_scaling_does_not_look_at_scored_data(spark):
    """Rows far from the training data keep their distance (they were scaled by their own moments before)."""
    scaler = Scaler.fit(frame_of(spark, ROWS))
    far = scaler.apply(frame_of(spark, [(0.0, 1000.0, 0.0, 0.0), (0.0, 1001.0, 0.0, 0.0)])).df.select("f_0").collect()
    assert all(r["f_0"] > 300 for r in far)


def test_train_job_with_scaling(spark, tmp_path):
    src = spark.range(400).select(
        (F.col("id") * 1e6 + 5e8).alias("big"), (F.col("id") % 2).cast("double").alias("noise"), (F.col("id") >= 200).alias("Y")
    )
    paths = write_matrix_csv(src, str(tmp_path / "in"))
    out = str(tmp_path / "model")
    result = train(spark, paths, out, reg_param=0.01, scale=True)
    model = load_model(spark, out)
    assert model == result.model and model.scaling is not None and "--scale" in model.arguments
    raw = FeatureFrame.from_columns(src, ["big", "noise"], label=F.col("Y").cast("double"))
    wrong = score(raw, model).where("label <> prediction").count()
    assert wrong <= 4
    # without centring and an intercept the classes can't be told apart
    assert score(raw, fit_logistic_l1(raw, reg_param=0.01)).where("label <> prediction").count() > 100
