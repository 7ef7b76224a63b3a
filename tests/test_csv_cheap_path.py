"""The cheap paths of the scan and the writer: same cells and files, less work."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glmframe.sources.csv_matrix import BACKSLASH_MARK, _may_be_header, _quoted_cells, cell_array


def test_split_and_field_pattern_agree(spark):
    """Any line has the same cells by the cheap path as by the field pattern."""
    draw = random.Random(3)
    signs = ["a", "1.5", ",", ",", " ", "\t", "\x00", '"', "\\", BACKSLASH_MARK, "é", " ", "\x85", "\x1f", "\xa0"]
    lines = ["", " ", ",", " , ", *("".join(draw.choices(signs, k=draw.randint(0, 9))) for _ in range(3000))]
    lines += ["".join(draw.choices(signs[:5], k=draw.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    rows = df.select("value", cell_array(F.col("value")).alias("a"), _quoted_cells(F.col("value")).alias("b")).collect()
    assert len(rows) == len(lines)
    assert [r for r in rows if r["a"] != r["b"]] == []


@pytest.mark.parametrize("header", [["a"], ["", ""], ["row key", "q,r", 'say "x"'], ["back\\slash", "é"], [f"c{i}" for i in range(50)]])
def test_no_header_line_escapes_the_search(spark, header):
    def written(name, escaped):
        text = name.replace("\\", "\\\\").replace('"', '""')
        if escaped and text:
            text = "\\" + text if text[0].isalpha() else text
        return f' "{text}"\t'

    lines = [",".join(written(n, e) for n in header) for e in (False, True)]
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    rows = df.select(cell_array(F.col("value")).alias("c"), _may_be_header(F.col("value"), header).alias("m")).collect()
    assert [(r["c"], r["m"]) for r in rows] == [(header, True)] * len(lines)


def test_plain_lines_cost_a_fraction_of_quoted_ones(spark):
    """A line without quotes isn't taken through the field pattern (both took the same time before)."""
    plain = spark.range(200_000).select(F.concat_ws(",", *[(F.col("id") + i).cast("string") for i in range(8)]).alias("value")).cache()
    quoted = plain.select(F.concat("value", F.lit(',"x"')).alias("value")).cache()
    assert plain.count() == quoted.count()

    def seconds(df):
        found = []
        for _ in range(3):
            start = time.monotonic()
            df.select(F.size(cell_array(F.col("value"))).alias("n")).agg(F.sum("n")).first()
            found.append(time.monotonic() - start)
        return min(found)

    try:
        assert seconds(plain) < 0.7 * seconds(quoted)
    finally:
        plain.unpersist()
        quoted.unpersist()
