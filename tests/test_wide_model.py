"""Models whose weights are rows, ranking and scoring without a driver list."""

import random

import pytest
from pyspark.sql import functions as F

from glmframe.operators import row_index
from glmframe.operators.model_report import weight_ranking, zero_weight_summary
from glmframe.sources import wide_model as wm
from glmframe.sources.model_store import LinearModel


def weights_of(spark, n):
    value = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double") - 500)
    return spark.range(0, n, 1, 8).select(F.col("id").alias("idx"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), value.alias("value"))


def test_round_trip_and_ranking(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wm, "WEIGHTS_PER_FILE", 5_000)
    model = wm.WideModel(weights_of(spark, 20_000), 0.5, "linear", ("--a",))
    path = model.save(str(tmp_path / "wide"))
    back = wm.load_wide_model(spark, path)
    assert (back.intercept, back.kind, back.arguments) == (0.5, "linear", ("--a",))
    assert back.weights.exceptAll(model.weights).count() == 0 and back.weights.count() == 20_000
    assert len(back.weights.inputFiles()) == 4
    got = weight_ranking(back.weights).orderBy("rank").collect()
    want = sorted((r for r in model.weights.collect() if r["value"]), key=lambda r: (-abs(r["value"]), r["idx"]))
    assert [(r["rank"], r["idx"]) for r in got] == [(k + 1, r["idx"]) for k, r in enumerate(want)]
    z = zero_weight_summary(back.weights).first()
    assert (z["zero"], z["total"]) == (20_000 - len(want), 20_000)


def test_ranking_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(row_index.with_row_index, "__defaults__", ("index", None, 100))
    ranking = weight_ranking(weights_of(spark, 1000))
    assert ranking.select(F.spark_partition_id()).distinct().count() == 7  # 666 weights, 100 a task


def test_millions_of_weights(spark, tmp_path):
    path = wm.WideModel(weights_of(spark, 3_000_000)).save(str(tmp_path / "wide"))
    ranking = weight_ranking(wm.load_wide_model(spark, path).weights)
    top = ranking.where("rank <= 3").collect()
    assert {abs(r["value"]) for r in top} == {500.0} and ranking.agg(F.max("rank")).first()[0] == ranking.count()


def test_duplicate_names_and_kinds(spark, tmp_path):
    twice = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0)], "idx BIGINT, name STRING, value DOUBLE")
    with pytest.raises(ValueError, match="more than once"):
        wm.WideModel(twice).save(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="kind must be"):
        wm.WideModel(twice, kind="tree")


@pytest.mark.parametrize("share", [1e-3, 0.05, 1.0])
def test_entries_score_like_a_loop(spark, share, monkeypatch):
    monkeypatch.setattr(wm, "COMMON_SHARE", share)
    rnd = random.Random(2)
    weights = {f"f{i}": rnd.choice([-1.0, 0.5, 2.0]) for i in range(50)}
    rows = [(r, "f0", 1.0) for r in range(300)]  # a name in every row
    rows += [(r, f"f{rnd.randrange(60)}", float(rnd.randrange(5))) for r in range(300) for _ in range(4)]
    rows += [(900, "unknown", 1.0), (901, "f1", None), (901, "f0", 1.0), (902, None, 1.0), (None, "f0", 3.0)]
    model = wm.WideModel.of(spark, LinearModel(tuple(weights), tuple(weights.values()), -1.0))
    entries = spark.createDataFrame(rows, "row BIGINT, name STRING, value DOUBLE").repartition(5)
    got = {r["row"]: (r["margin"], r["prediction"]) for r in wm.score_entries(entries, model, ["row"]).collect()}
    for row in {r for r, *_ in rows}:
        own = [(n, v) for r, n, v in rows if r == row and n in weights]
        margin = None if any(v is None for _, v in own) else sum(weights[n] * v for n, v in own) - 1.0
        assert got[row] == (margin, None if margin is None else float(margin > 0))
    assert wm.score_entries(entries.limit(0), model, ["row"]).count() == 0
