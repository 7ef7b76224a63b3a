"""The matrix CSV writer: shuffles only what needs it, quotes only what can need it."""

from pyspark.sql import functions as F

from glmframe.sources.csv_matrix import read_matrix, write_matrix_csv


def test_enough_partitions_are_written_as_they_are(spark, tmp_path):
    """Rows in enough partitions aren't shuffled to be written (they always were), fewer are spread."""
    slots = spark.sparkContext.defaultParallelism
    for parts, files in ((2 * slots, 2 * slots), (1, slots)):
        df = spark.range(0, 1000, 1, parts).select("id", (F.col("id") % 2 == 0).alias("Y"))
        paths = write_matrix_csv(df, str(tmp_path / f"m{parts}"))
        assert len([f for f in (tmp_path / f"m{parts}" / "1-rows").iterdir() if f.name.startswith("part-")]) == files
        got = read_matrix(spark, paths).df.agg(F.count("*"), F.sum("f_0"), F.sum("label")).first()
        assert tuple(got) == (1000, 499500.0, 500.0)


def test_written_cells_of_every_type_are_read_back(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, -2.5e20, True, 'a,"b\\\r\n\nc'), (None, float("nan"), None, ""), (3, 0.1, False, None)], "i INT, d DOUBLE, b BOOLEAN, t STRING"
    )
    paths = write_matrix_csv(df.coalesce(1), str(tmp_path / "m"), keep_order=True)
    lines = [r[0] for r in spark.read.text(paths[1]).collect()]
    assert lines == ['1,-2.5E20,true,"a,""b\\\\ c"', ",NaN,,", "3,0.1,false,"]
