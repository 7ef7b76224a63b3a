"""Cell texts: the words before the numbers, fixed texts of the classes."""

import time

from pyspark.sql import functions as F

from glmframe.functions.numeric import format_fixed, lenient_number


def _seconds(df, column):
    found = []
    for _ in range(3):
        start = time.monotonic()
        df.select(column.alias("x")).agg(F.sum("x")).first()
        found.append(time.monotonic() - start)
    return min(found)


def test_words_cost_no_failed_number_parse(spark):
    """A true/false cell is no dearer than a number (it was many times dearer, by a failed parse)."""
    cells = spark.range(400_000).select(
        F.when(F.col("id") % 2 == 0, "true").otherwise("FALSE").alias("word"), (F.col("id") / 7).cast("string").alias("number")
    ).cache()
    assert cells.count() == 400_000
    try:
        assert _seconds(cells, lenient_number("word")) < 2 * _seconds(cells, lenient_number("number"))
    finally:
        cells.unpersist()


def test_fixed_text_of_any_double(spark):
    values = [0.0, -0.0, 1.0, -1.0, 10.0, 0.5, 1e-7, 123456789.1234567, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (0, 2, 6):
        rows = df.select(format_fixed("v", digits).alias("a"), F.format_string(f"%.{digits}f", "v").alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_classes_need_no_formatter(spark):
    """The text of a class comes without the formatter (all values went through it before)."""
    df = spark.range(400_000).select((F.col("id") % 2).cast("double").alias("v"), (F.col("id") % 2 + 0.25).alias("w")).cache()
    assert df.count() == 400_000
    try:
        assert _seconds(df, F.length(format_fixed("v"))) < 0.8 * _seconds(df, F.length(format_fixed("w")))
    finally:
        df.unpersist()
