
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glmframe.frame import FeatureFrame
from glmframe.operators.model_report import weight_ranking, zero_weight_summary
from glmframe.operators.profile import drop_constant_features
from glmframe.operators.row_index import with_row_index
from glmframe.sources.model_store import LinearModel, load_model

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
small = st.sampled_from([0.0, -0.0, 1.0, -1.0, 2.5, 0.5, -2.5, 3.0])


@FAST
@given(st.lists(small, min_size=1, max_size=12))
def test_ranking_is_a_permutation_of_nonzero_weights(spark, weights):
    names = tuple(f"w{i}" for i in range(len(weights)))
    w = LinearModel(names, tuple(weights)).weights_df(spark)
    ranked = [(r["idx"], r["value"]) for r in weight_ranking(w).orderBy("rank").collect()]
    nonzero = [(i, v) for i, v in enumerate(weights) if v != 0.0]
    assert sorted(ranked) == sorted(nonzero)
    assert ranked == sorted(nonzero, key=lambda t: (-abs(t[1]), t[0]))  # |w| desc, ties by index
    z = zero_weight_summary(w).first()
    assert (z["zero"], z["total"]) == (len(weights) - len(nonzero), len(weights))


@FAST
@given(st.lists(st.tuples(st.integers(0, 1), small, small, small), min_size=1, max_size=20),
       st.lists(st.integers(0, 2), min_size=1, max_size=5))
def test_projection_keeps_rows_and_labels(spark, rows, idx):
    df = spark.createDataFrame([(float(a), b, c, d) for a, b, c, d in rows], "y DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE")
    fr = FeatureFrame.from_columns(df, ["a", "b", "c"], label="y")
    out = fr.project_by_index(idx)
    got = out.df.collect()
    assert len(got) == len(rows)
    assert sorted(r["label"] for r in got) == sorted(float(a) for a, *_ in rows)
    assert out.feature_names == tuple("abc"[i] for i in idx)


@FAST
@given(st.lists(st.tuples(small, small, small), min_size=1, max_size=15))
def test_drop_constants_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE")
    fr = FeatureFrame.from_columns(df, ["a", "b", "c"])
    once = drop_constant_features(fr)
    assert drop_constant_features(once) is once
    for i, name in enumerate(("a", "b", "c")):
        values = {r[i] for r in rows}
        assert (name in once.feature_names) == (len(values) > 1)


@FAST
@given(st.lists(st.integers(-3, 3), min_size=0, max_size=60), st.integers(1, 7))
def test_indices_are_dense_and_ordered(spark, keys, buckets):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k INT, payload INT")
    out = with_row_index(df, ["k"], num_partitions=buckets, rows_per_bucket=5).collect()
    assert sorted(r["index"] for r in out) == list(range(len(keys)))
    ordered = [r["k"] for r in sorted(out, key=lambda r: r["index"])]
    assert ordered == sorted(keys)


@FAST
@given(st.lists(small, min_size=1, max_size=8), small)
def test_save_load_save_is_equal(spark, tmp_path_factory, weights, intercept):
    m = LinearModel(tuple(f"n{i}" for i in range(len(weights))), tuple(weights), intercept)
    p1 = str(tmp_path_factory.mktemp("m") / "a")
    p2 = str(tmp_path_factory.mktemp("m") / "b")
    once = load_model(spark, m.save(spark, p1))
    twice = load_model(spark, once.save(spark, p2))
    assert once == twice
    assert once.weights == m.weights and once.names == m.names and once.intercept == intercept
