"""Training, the two end-to-end jobs, streaming scoring."""

import pytest
from pyspark.sql import functions as F

from glmframe.frame import FeatureFrame
from glmframe.operators.scoring import confusion_counts, score
from glmframe.operators.train import fit_linear, fit_logistic_l1
from glmframe.plans.commands import predict, train
from glmframe.sources.csv_matrix import read_matrix, write_matrix_csv
from glmframe.sources.model_store import LinearModel
from glmframe.streaming.scoring import ScoringCounters, read_matrix_stream, start_keyed_scoring

from conftest import SF_MID


def learn(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    return FeatureFrame.from_columns(
        li,
        {"q": F.col("l_quantity") - 25.5, "l_discount": "l_discount", "l_tax": "l_tax"},
        label=(F.col("l_quantity") > 25).cast("double"),
    )


def test_l1_logistic_learns_the_separating_feature(spark):
    fr = learn(spark)
    m = fit_logistic_l1(fr, reg_param=0.1)
    assert m.weights[0] == pytest.approx(0.1376, abs=5e-4)
    assert m.weights[1:] == (0.0, 0.0) and m.intercept == 0.0
    wrong = [r for r in confusion_counts(score(fr, m)).collect() if r["label"] != r["prediction"]]
    assert wrong == []


def test_default_regularisation_gives_null_model(spark):
    m = fit_logistic_l1(learn(spark))
    assert m.weights == (0.0, 0.0, 0.0)


def test_linear_fit_matches_least_squares(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    fr = FeatureFrame.from_columns(li, ["l_quantity"], label="l_extendedprice")
    m = fit_linear(fr, reg_param=0.0, fit_intercept=True, solver="normal")
    ref = li.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()
    assert m.weights[0] == pytest.approx(ref[0], rel=1e-9)
    assert m.intercept == pytest.approx(ref[1], rel=1e-6)


def test_train_then_predict_commands(spark, tmp_path, write_lines):
    rows = ["x,noise,Y"] + [f"{i - 50},{(i * 7) % 5},{1 if i > 50 else 0}" for i in range(100)]
    path = write_lines(rows[:60], [rows[0]] + rows[60:])
    model_path = str(tmp_path / "model")
    res = train(spark, path, out=model_path, reg_param=0.01)
    assert res.rows == 100 and res.positives == 49
    assert res.model.weights[0] > 0
    out = str(tmp_path / "pred")
    indexed = predict(spark, path, model_path, out=out)
    got = sorted((r["index"], r["prediction"]) for r in indexed.collect())
    assert [i for i, _ in got] == list(range(100))
    assert [p for _, p in got] == [1.0 if i > 50 else 0.0 for i in range(100)]
    lines = spark.read.text(out).collect()
    text = [r["value"] for r in lines]
    assert text.count("index, prediction") >= 1
    assert "0, 0.000000" in text and "99, 1.000000" in text
    back = read_matrix(spark, out, target="").df.count()
    assert back == 100
    acc = predict(spark, path, model_path, test=True).first()
    assert acc["accuracy"] == 1.0
    keyed_rows = ["k,x,noise,Y"] + [f"r{i},{i - 50},{(i * 7) % 5},0" for i in range(100)]
    keyed_in = write_lines(keyed_rows)
    keyed = predict(spark, keyed_in, model_path, row_labels="k", out=str(tmp_path / "keyed"))
    got_keyed = {r["k"]: r["prediction"] for r in keyed.collect()}
    assert got_keyed["r99"] == 1.0 and got_keyed["r0"] == 0.0 and len(got_keyed) == 100


def test_streaming_scoring(spark, tmp_path):
    df = spark.range(200).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        (F.col("id") - 100).alias("x"),
        F.when(F.col("id") > 100, "true").otherwise("false").alias("Y"),
    )
    paths = write_matrix_csv(df, str(tmp_path / "in"))
    fr = read_matrix_stream(spark, paths[1], ["key", "x", "Y"], carry=["key"])
    assert fr.df.isStreaming
    out = str(tmp_path / "out")
    q = start_keyed_scoring(fr, LinearModel(("x",), (1.0,)), ["key"], out, checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r["key"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    assert len(got) == 200 and got["k150"] == 1.0 and got["k100"] == 0.0 and got["k3"] == 0.0


def test_command_line(spark, tmp_path, write_lines, capsys):
    from glmframe.__main__ import main

    rows = ["id,x,Y"] + [f"r{i},{i - 50},{1 if i > 50 else 0}" for i in range(100)]
    path = write_lines(rows)
    model = str(tmp_path / "m")
    assert main(["train-linear", "--input", path, "--out", model, "--reg-param", "0.01", "--ignore", "id"]) == 0
    out = capsys.readouterr().out
    assert "Label 1 on 49 of 100 rows (49.000000%)" in out
    assert "Input: 100 rows, 1 features, " in out
    assert "                    x = " in out
    assert main(["predict-linear", "--input", path, "--model", model, "--ignore", "id", "--test"]) == 0
    assert "Accuracy: 100 / 100 = 1.000000" in capsys.readouterr().out
    from glmframe.sources.model_store import read_model_df

    prov = read_model_df(spark, model).first()["provenance"]
    assert list(prov["arguments"])[:3] == ["train-linear", "--input", path]
    assert main(["predict-linear", "--input", path, "--model", model, "--ignore", "id", "--test", "--align", "position"]) == 0


def test_streaming_packed(spark, tmp_path):
    df = spark.range(50).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        (F.col("id") - 25).alias("x"),
        F.lit(1.0).alias("z"),
        F.when(F.col("id") > 25, "true").otherwise("false").alias("Y"),
    )
    paths = write_matrix_csv(df, str(tmp_path / "in"))
    fr = read_matrix_stream(spark, paths[1], ["key", "x", "z", "Y"], carry=["key"], packed=True)
    assert fr.packed and fr.df.isStreaming
    out = str(tmp_path / "out")
    q = start_keyed_scoring(fr, LinearModel(("x", "z"), (1.0, 0.0)), ["key"], out, checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r["key"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    assert len(got) == 50 and got["k40"] == 1.0 and got["k25"] == 0.0


def test_tree_depth_keeps_driver_merge_bounded():
    from glmframe.operators.train import DRIVER_MERGE_BYTES, tree_depth

    assert tree_depth(8, 4) == 2
    assert tree_depth(5000, 100) == 2
    for partitions, width in [(100_000, 1_000_000), (1_000_000, 100_000), (10_000, 1_000_000)]:
        d = tree_depth(partitions, width)
        assert d > 2
        assert partitions ** (1.0 / d) * (8 * width + 64) <= DRIVER_MERGE_BYTES
        assert partitions ** (1.0 / (d - 1)) * (8 * width + 64) > DRIVER_MERGE_BYTES or d == 3
    with pytest.raises(ValueError, match="exceeds the budget"):
        tree_depth(10_000, 50_000_000)


def test_predict_write_and_test_in_one_pass(spark, tmp_path, write_lines):
    rows = ["x,Y"] + [f"{i - 20},{1 if i > 25 else 0}" for i in range(40)]
    path = write_lines(rows)
    model_path = LinearModel(("x",), (1.0,)).save(spark, str(tmp_path / "m"))
    acc = predict(spark, path, model_path, out=str(tmp_path / "p"), test=True).first()
    # rows 21..25 have x > 0 (predicted 1) but label 0: 5 wrong of 40
    assert (acc["rows"], acc["correct"]) == (40, 35) and acc["accuracy"] == 35 / 40
    assert spark.read.text(str(tmp_path / "p")).count() >= 41


@pytest.mark.parametrize("key", ["index", "label", "prediction", "a.b"])
def test_row_labels_of_any_name(spark, tmp_path, write_lines, key):
    path = write_lines([f"{key},x,Y", "r1,1,1", "r2,-1,0"])
    model = LinearModel(("x",), (1.0,)).save(spark, str(tmp_path / "m"))
    out = str(tmp_path / "out")
    predict(spark, path, model, out=out, row_labels=key)
    lines = sorted(r[0] for r in spark.read.text(out).collect() if not r[0].startswith(key))
    assert lines == ["r1, 1.000000", "r2, 0.000000"]


def test_stream_counters_per_batch(spark, write_lines):
    folder = write_lines(["id,x", "a,1", "b,none"], ["id,x", "c,2"], ["id,x", "d,", "e,x", "f,3"])
    frame = read_matrix_stream(spark, folder, ["id", "x"], target=None, carry=["id"], on_error="null", max_files_per_trigger=1)
    query = start_keyed_scoring(frame, LinearModel(("x",), (1.0,)), ["id"], folder + "-out")
    query.awaitTermination()
    counters = ScoringCounters().update(query).update(query)
    assert (counters.scored, counters.unscored) == (3, 3)
    assert sorted((r["scored"], r["unscored"]) for r in counters.to_df(spark).collect()) == [(1, 0), (1, 1), (1, 2)]
    counters.batches.pop(1)
    with pytest.raises(RuntimeError, match="dropped"):
        ScoringCounters({0: (1, 1), 5: (1, 1)}).update(query)
