"""Truncated listing (FIXTURES.md section 5) and the distributed row index."""

import random

import pytest
from pyspark.sql import functions as F

from glmframe.functions.listing import truncated_listing
from glmframe.operators import prefix_sums
from glmframe.operators.row_index import with_input_order_index, with_row_index
from glmframe.sources.csv_matrix import ORDER_COLS, read_matrix


@pytest.mark.parametrize(
    "pieces, budget, expected",
    [
        (["aa", "bb", "cc"], 100, "aa,bb,cc"),
        (["aa", "bb", "cc"], 10, "aa,bb, [...]"),
        (["aa", "bb", "cc"], 6, " [...]"),
        ([], 5, ""),
    ],
)
def test_truncated_listing_cases(spark, pieces, budget, expected):
    rows = [("g", i, p) for i, p in enumerate(pieces)]
    if rows:
        df = spark.createDataFrame(rows, "g STRING, k INT, p STRING")
        assert truncated_listing(df, ["g"], "k", "p", budget).first()["listing"] == expected


def brute(pieces, budget):
    """The longest run of first pieces that leaves room for the ellipsis before each of them."""
    n = 0
    while n < len(pieces) and budget - sum(len(p) + 1 for p in pieces[:n]) > 6:
        n += 1
    return ",".join(pieces[:n]) + ("" if n == len(pieces) else ", [...]" if n else " [...]")


def test_null_group_and_null_pieces(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), ("x", 1, None), ("y", 1, "c"), ("y", 2, None)]
    df = spark.createDataFrame(rows, "g STRING, k INT, p STRING")
    got = {r["g"]: r["listing"] for r in truncated_listing(df, ["g"], "k", "p", 100).collect()}
    assert got == {None: "a,b", "x": "", "y": "c"}


def test_grouped_listing_matches_loop_on_random_groups(spark):
    rnd = random.Random(7)
    groups = {g: ["x" * rnd.randint(0, 9) for _ in range(rnd.randint(1, 15))] for g in range(60)}
    rows = [(g, i, p) for g, pieces in groups.items() for i, p in enumerate(pieces)]
    df = spark.createDataFrame(rows, "g INT, k INT, p STRING")
    for budget in (0, 5, 6, 7, 12, 40):
        got = {r["g"]: r["listing"] for r in truncated_listing(df, ["g"], "k", "p", budget).collect()}
        assert got == {g: brute(pieces, budget) for g, pieces in groups.items()}


def test_row_index_splits_equal_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("k"))
    out = with_row_index(df, ["k"], rows_per_bucket=2_500)
    assert out.rdd.getNumPartitions() == 8
    rows = out.select("index", "k", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["index"] for r in rows) == list(range(20_000))
    assert all((r["index"] >= 10_000) == (r["k"] == 1) for r in rows)
    assert len({r["p"] for r in rows}) >= 6


def test_row_index_dense_ordered_with_hot_key(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([5] * 10 + list(range(40))), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(data, "k INT, v DOUBLE").repartition(5)
    out = with_row_index(df, ["k"], num_partitions=7, rows_per_bucket=100).collect()
    idx = sorted(r["index"] for r in out)
    assert idx == list(range(len(data)))
    by_index = sorted(out, key=lambda r: r["index"])
    keys = [r["k"] for r in by_index]
    assert keys == sorted(keys)


def test_row_index_empty_input(spark):
    df = spark.createDataFrame([], "k INT")
    assert with_row_index(df, ["k"]).count() == 0


def test_input_order_index_over_files(spark, write_lines):
    files = [["a,Y"] + [f"{i},0" for i in range(j * 100, j * 100 + 100)] for j in range(4)]
    path = write_lines(*files)
    fr = read_matrix(spark, path, keep_order=True)
    idx = with_input_order_index(fr.df, *ORDER_COLS).collect()
    assert sorted((r["index"], r["f_0"]) for r in idx) == [(i, float(i)) for i in range(400)]


def joined(pieces, budget):
    """The same without a separator."""
    n = 0
    while n < len(pieces) and budget - sum(map(len, pieces[:n])) > 6:
        n += 1
    return "".join(pieces[:n]) + ("" if n == len(pieces) else " [...]")


def test_listing_without_separator(spark, monkeypatch):
    monkeypatch.setattr(prefix_sums.with_running_total, "__defaults__", ("total_before", 50))
    rnd = random.Random(8)
    groups = {g: ["x" * rnd.choice([0, 0, 1, 5]) for _ in range(rnd.randint(1, 40))] for g in [None, *range(20)]}
    groups[7] = [""] * 500 + ["abc"] * 3 + [""] * 10  # hot, and most of it empty
    groups[8] = [""] * 30
    rows = [(g, i, p) for g, pieces in groups.items() for i, p in enumerate(pieces)] + [(8, 99, None)]
    df = spark.createDataFrame(rows, "g INT, k INT, p STRING").repartition(6)
    for budget in (0, 6, 7, 12, 40, 10_000):
        got = {r["g"]: r["listing"] for r in truncated_listing(df, ["g"], "k", "p", budget, separator="").collect()}
        assert got == {g: joined(pieces, budget) for g, pieces in groups.items()}


def test_hot_group_of_a_million_pieces_spreads_over_tasks(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("g").alias("g"), "id", F.lit("").alias("p"))
    df = df.union(spark.createDataFrame([("g", 2_000_000, "end"), ("g", 2_000_001, "no room")], df.schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        total = prefix_sums.with_running_total(df, ["g"], ["id"], F.length("p"), rows_per_bucket=50_000)
        spread = total.groupBy(F.spark_partition_id().alias("t")).count().agg(F.count("*"), F.max("count")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread[0] >= 5 and spread[1] < 400_000
    assert truncated_listing(df, ["g"], "id", "p", 9, separator="").first()["listing"] == "end [...]"


def test_running_totals_match_a_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(30), rnd.choice([None, 1, 2, 5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g STRING, `k.x` INT, v INT").repartition(4)
    out = prefix_sums.with_running_total(df, ["g"], ["k.x"], F.col("v"), rows_per_bucket=37).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in out if r["g"] == g), key=lambda r: (r["k.x"], r["total_before"]))
        spent = 0
        for k, r in enumerate(own):
            if k == 0 or r["k.x"] != own[k - 1]["k.x"]:
                assert r["total_before"] == spent == sum(x["v"] or 0 for x in own if x["k.x"] < r["k.x"])
            spent += r["v"] or 0
    assert len(out) == len(rows)


def test_input_order_index_moves_no_rows(spark, write_lines):
    """No exchange and no join in the plan, many splits in one partition included."""
    folder = write_lines(*[["x,Y", *(f"{f * 10 + i},1" for i in range(f % 4))] for f in range(30)])
    frame = read_matrix(spark, folder, keep_order=True)
    out = with_input_order_index(frame.df, *ORDER_COLS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = sorted(out.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [r["f_0"] for r in rows] == sorted(r["f_0"] for r in rows)
