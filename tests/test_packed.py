"""Packed (array) layout: same answers as the wide layout, any width."""

import math

import pytest
from pyspark.sql import functions as F

from glmframe.frame import PACKED, FeatureFrame
from glmframe.operators.profile import constant_feature_flags, drop_constant_features
from glmframe.operators.scaling import standardize
from glmframe.operators.scoring import score
from glmframe.operators.train import fit_logistic_l1
from glmframe.sources.csv_matrix import read_matrix
from glmframe.sources.model_store import LinearModel

NAN = float("nan")
ROWS = [
    (1.0, 1.0, 5.0, NAN, 0.0, 2.0),
    (0.0, 1.0, 6.0, NAN, -0.0, -1.0),
    (1.0, 1.0, 7.0, 3.0, 0.0, 4.0),
    (0.0, 1.0, 8.0, NAN, 0.0, 0.5),
]
NAMES = ["one", "up", "nans", "zero", "mix"]


def frames(spark):
    df = spark.createDataFrame(ROWS, "label DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE")
    exprs = dict(zip(NAMES, ["a", "b", "c", "d", "e"]))
    wide = FeatureFrame.from_columns(df, exprs, label="label", packed=False)
    packed = FeatureFrame.from_columns(df, exprs, label="label", packed=True)
    return wide, packed


def canon(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


def test_layouts(spark):
    wide, packed = frames(spark)
    assert not wide.packed and packed.packed
    assert packed.df.columns == ["label", PACKED]
    assert canon(wide.to_df().collect()) == canon(packed.to_df().collect())
    assert canon(packed.to_wide().df.collect()) == canon(wide.df.collect())


def test_flags_and_drop_agree(spark):
    wide, packed = frames(spark)
    fw = sorted(tuple(r) for r in constant_feature_flags(wide).collect())
    fp = sorted(tuple(r) for r in constant_feature_flags(packed).collect())
    assert fw == fp == [(0, "one", True), (1, "up", False), (2, "nans", False), (3, "zero", True), (4, "mix", False)]
    dw, dp = drop_constant_features(wide), drop_constant_features(packed)
    assert dw.feature_names == dp.feature_names == ("up", "nans", "mix")
    assert dp.packed
    assert canon(dw.df.collect()) == canon(dp.to_wide().df.collect())


def test_standardize_agrees(spark):
    wide, packed = frames(spark)
    sw = standardize(wide).to_df(named=True).collect()
    sp = standardize(packed).to_df(named=True).collect()
    norm = lambda rows: canon([tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows])
    assert norm(sw) == norm(sp)


def test_score_and_fit_agree(spark):
    wide, packed = frames(spark)
    model = LinearModel(tuple(NAMES), (0.5, 0.25, 0.0, 3.0, -1.0), 0.1)
    a = sorted((r["margin"], r["prediction"]) for r in score(wide, model).collect())
    b = sorted((r["margin"], r["prediction"]) for r in score(packed, model).collect())
    assert [x[1] for x in a] == [x[1] for x in b]
    assert all((math.isnan(x[0]) and math.isnan(y[0])) or x[0] == pytest.approx(y[0]) for x, y in zip(a, b))
    fw = drop_constant_features(wide).project(["up", "mix"])
    fp = drop_constant_features(packed).project(["up", "mix"])
    assert fit_logistic_l1(fw, reg_param=0.01).weights == pytest.approx(fit_logistic_l1(fp, reg_param=0.01).weights)


def test_packed_csv_scores(spark, write_lines):
    width = 250
    header = ",".join(f"x{i}" for i in range(width)) + ",Y"
    rows = [",".join(str((r * 7 + i) % 11) for i in range(width)) + f",{r % 2}" for r in range(40)]
    path = write_lines([header] + rows)
    fr = read_matrix(spark, path, packed=True)
    assert fr.packed and fr.width == width
    model = LinearModel(fr.feature_names, tuple(1.0 if i == 3 else 0.0 for i in range(width)))
    got = sorted((r["margin"]) for r in score(fr, model).collect())
    assert got == sorted(float((r * 7 + 3) % 11) for r in range(40))
    assert drop_constant_features(fr).width == width
    assert fr.project(["x5", "x1"]).to_df().columns == ["label", "x5", "x1"]


def test_from_array(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([3.0, 4.0], 0.0)], "v ARRAY<DOUBLE>, y DOUBLE")
    fr = FeatureFrame.from_array(df, "v", ["p", "q"], label="y")
    m = LinearModel(("q", "p"), (1.0, 10.0))
    assert sorted(r["margin"] for r in score(fr, m).collect()) == [12.0, 34.0]
    assert sorted(F_ for F_ in fr.to_df().columns) == ["label", "p", "q"]
    assert fr.df.select(F.size(PACKED)).first()[0] == 2


def test_profiles_agree_between_layouts_at_any_width(spark):
    """NULL and NaN cells, a far-off column, 40 features: the same flags and moments either way."""
    rows = []
    for r in range(30):
        vals = [float((r * (i + 3)) % 7) if i % 5 else 1.0 for i in range(40)]
        vals[7] = NAN if r % 4 == 0 else 2.0
        vals[9] = -0.0 if r % 2 else 0.0
        vals[11] = None if r % 3 else 4.0
        vals[12] = 1e9 + r
        rows.append(tuple([float(r % 2)] + vals))
    schema = "label DOUBLE, " + ", ".join(f"c{i} DOUBLE" for i in range(40))
    df = spark.createDataFrame(rows, schema)
    wide, packed = (
        FeatureFrame.from_columns(df, [f"c{i}" for i in range(40)], label="label", packed=p) for p in (False, True)
    )
    flags = [sorted(tuple(r) for r in constant_feature_flags(f).collect()) for f in (wide, packed)]
    assert flags[0] == flags[1]
    assert drop_constant_features(wide).feature_names == drop_constant_features(packed).feature_names
    norm = lambda f: canon([tuple(None if v is None else round(v, 9) if not math.isnan(v) else v for v in r) for r in f.to_df().collect()])
    assert norm(standardize(wide)) == norm(standardize(packed))


def test_array_of_another_length_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v ARRAY<DOUBLE>")
    fr = FeatureFrame.from_array(df, "v", ["p", "q"])
    with pytest.raises(Exception, match="not 2 long but 3"):
        fr.df.collect()


def test_empty_input_in_both_layouts(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0)], "a DOUBLE, b DOUBLE, y DOUBLE").where(F.lit(False))
    for packed in (False, True):
        fr = FeatureFrame.from_columns(df, ["a", "b"], label="y", packed=packed)
        assert drop_constant_features(fr).feature_names == ("a", "b")
        assert sorted(tuple(r) for r in constant_feature_flags(fr).collect()) == [(0, "a", True), (1, "b", True)]
        assert standardize(fr).df.collect() == []


def test_predict_wide_csv_in_input_order(spark, tmp_path, write_lines):
    from glmframe.plans.commands import predict

    width = 210
    header = ",".join(f"x{i}" for i in range(width)) + ",Y"
    files = []
    for part in range(3):
        rows = [",".join(str(r if i == 0 else 0) for i in range(width)) + ",0" for r in range(part * 20 - 30, part * 20 - 10)]
        files.append([header] + rows)
    path = write_lines(*files)
    model_path = LinearModel(tuple(f"x{i}" for i in range(width)), tuple(1.0 if i == 0 else 0.0 for i in range(width))).save(
        spark, str(tmp_path / "m")
    )
    got = sorted((r["index"], r["margin"], r["prediction"]) for r in predict(spark, path, model_path).collect())
    assert [g[0] for g in got] == list(range(60))
    assert [g[1] for g in got] == [float(x) for x in range(-30, 30)]
    assert [g[2] for g in got] == [1.0 if x > 0 else 0.0 for x in range(-30, 30)]
