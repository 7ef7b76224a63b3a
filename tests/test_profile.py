"""Label profile, constant features (FIXTURES.md section 3), standardising."""

import math

import pytest
from pyspark.sql import functions as F

from glmframe.frame import FeatureFrame
from glmframe.operators.profile import (
    constant_feature_flags,
    drop_constant_features,
    label_distribution,
    matrix_shape,
    observe_counters,
    positive_rate,
)
from glmframe.operators.scaling import standardize

NAN = float("nan")


def frame_of(spark, cols: dict[str, list[float]], labels=None):
    n = len(next(iter(cols.values())))
    labels = labels or [0.0] * n
    data = [tuple([labels[i]] + [cols[k][i] for k in cols]) for i in range(n)]
    schema = "label DOUBLE, " + ", ".join(f"{k} DOUBLE" for k in cols)
    df = spark.createDataFrame(data, schema)
    return FeatureFrame.from_columns(df, list(cols), label="label")


@pytest.mark.parametrize(
    "values, kept",
    [
        ([1.0, 1.0, 1.0], False),
        ([1.0, 1.0, 2.0], True),
        ([0.0, -0.0], False),
        ([NAN, NAN], True),
        ([NAN, 1.0], True),
        ([7.0], False),
        ([NAN], False),
        ([math.inf, math.inf], False),
    ],
)
def test_constant_feature_cases(spark, values, kept):
    fr = frame_of(spark, {"x": values, "ref": [float(i) for i in range(len(values))]})
    flags = {r["name"]: r["is_constant"] for r in constant_feature_flags(fr).collect()}
    assert flags["x"] is (not kept)
    out = drop_constant_features(fr)
    assert ("x" in out.feature_names) is kept


def test_drop_constants_is_idempotent_and_keeps_rows(spark):
    fr = frame_of(spark, {"a": [1.0, 1.0, 1.0], "b": [1.0, 2.0, 3.0], "c": [5.0, 5.0, 5.0]}, [1.0, 0.0, 1.0])
    once = drop_constant_features(fr)
    assert once.feature_names == ("b",)
    assert drop_constant_features(once) is once
    assert sorted(tuple(r) for r in once.df.collect()) == [(0.0, 2.0), (1.0, 1.0), (1.0, 3.0)]


def test_drop_constants_on_empty_input_keeps_all(spark):
    fr = frame_of(spark, {"a": [1.0], "b": [2.0]})
    empty = fr.with_df(fr.df.where(F.lit(False)))
    assert drop_constant_features(empty).feature_names == ("a", "b")


def test_label_distribution_and_rate(spark):
    fr = frame_of(spark, {"a": [1.0, 2.0, 3.0, 4.0]}, [1.0, 0.0, 1.0, 1.0])
    assert sorted(tuple(r) for r in label_distribution(fr).collect()) == [(0.0, 1), (1.0, 3)]
    assert tuple(positive_rate(fr).first()) == (3, 4, 75.0)
    assert tuple(matrix_shape(fr).first()) == (4, 1)


def test_rate_without_positive_rows_is_zero(spark):
    fr = frame_of(spark, {"a": [1.0, 2.0]}, [0.0, 0.0])
    assert tuple(positive_rate(fr).first()) == (0, 2, 0.0)


def test_standardize(spark):
    fr = frame_of(spark, {"a": [1.0, 2.0, 3.0], "k": [4.0, 4.0, 4.0]})
    got = sorted((r["f_0"], r["f_1"]) for r in standardize(fr).df.collect())
    assert [round(a, 12) for a, _ in got] == [-1.0, 0.0, 1.0]
    assert {k for _, k in got} == {0.0}


def test_observed_counters(spark):
    fr = frame_of(spark, {"a": [1.0, 2.0, 3.0]}, [1.0, 0.0, 1.0])
    df, obs = observe_counters(fr.df, "t", rows=F.count(F.lit(1)), pos=F.count_if(F.col("label") == 1.0))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "pos": 2}


def test_projections(spark):
    fr = frame_of(spark, {"a": [1.0], "b": [2.0], "c": [3.0]})
    assert fr.project(["c", "a", "c"]).feature_names == ("c", "a", "c")
    assert tuple(fr.project(["c", "a", "c"]).df.first()) == (0.0, 3.0, 1.0, 3.0)
    assert fr.project_by_index([0, 1, 2]) is fr
    assert fr.select_features(ignore="b").feature_names == ("a", "c")
    with pytest.raises(KeyError):
        fr.project(["zz"])
    with pytest.raises(ValueError):
        fr.transform(lambda df: df.drop("f_0"))
    doubled = fr.transform(lambda df: df.withColumn("f_0", F.col("f_0") * 2))
    assert doubled.df.first()["f_0"] == 2.0


def test_checkpoint_keeps_rows_and_cuts_lineage(spark):
    fr = frame_of(spark, {"a": [1.0, 2.0, 3.0]}, [1.0, 0.0, 1.0])
    cp = fr.checkpoint()
    assert sorted(tuple(r) for r in cp.df.collect()) == sorted(tuple(r) for r in fr.df.collect())
    assert "LogicalRDD" in cp.df._jdf.queryExecution().logical().toString()
