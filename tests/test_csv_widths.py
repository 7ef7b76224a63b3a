"""One parse for every width: escapes, long cells, wide headers, odd paths, missing cells."""

import pytest
from pyspark.sql import functions as F

from glmframe.operators.scoring import accuracy, score
from glmframe.sources.csv_matrix import cell_array, read_header, read_matrix, write_matrix_csv
from glmframe.sources.model_store import LinearModel


@pytest.mark.parametrize(
    "line, cells",
    [
        (r'"e\\\\",4,0', ["e\\", "4", "0"]),
        (r'"a\\"b",1', ['a"b', "1"]),
        (r'"a\\\\\\"b",1', ['a\\"b', "1"]),
        (r"lone\\x,1", ["lonex", "1"]),
        ('"bad,2,1', ["bad,2,1"]),
        ('"q""q", " x " ,', ['q"q', "x", ""]),
        ("", [""]),
    ],
)
def test_cells_of_a_line(spark, line, cells):
    line = line.replace("\\\\", "\\")
    assert list(spark.range(1).select(cell_array(F.lit(line)).alias("c")).first()["c"]) == cells


def test_long_quoted_cell(spark):
    text = 'x""' * 350_000
    got = spark.range(1).select(F.length(cell_array(F.lit(f'"{text}",1'))[0]).alias("n")).first()["n"]
    assert got == 700_000


def test_few_features_of_a_wide_file_and_a_wide_header(spark, write_lines):
    width = 5000
    rows = [",".join(str((r + i) % 9) for i in range(width)) + f",{r % 2}" for r in range(4)]
    path = write_lines([",".join(f"x{i}" for i in range(width)) + ",Y"] + rows)
    fr = read_matrix(spark, path, max_features=10)
    assert sorted(r["f_9"] for r in fr.df.collect()) == [0.0, 1.0, 2.0, 3.0]
    assert len(read_header(spark, write_lines([",".join(f"c{i}" for i in range(25_001))]))) == 25_001


@pytest.mark.parametrize("name", ["my dir", "50%25", "a[1]", "{x}"])
def test_odd_folder_names(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "part.csv").write_text("a,Y\n3,1\n")
    escaped = str(folder).replace("[", "\\[").replace("{", "\\{").replace("]", "\\]").replace("}", "\\}")
    assert read_header(spark, escaped) == ["a", "Y"]


def test_written_cells_read_back(spark, tmp_path):
    cells = ["a,b", 'q"q', "back\\slash", " x", ""]
    df = spark.createDataFrame([(c, 1.5, 1.0) for c in cells], "k STRING, a DOUBLE, Y DOUBLE")
    paths = write_matrix_csv(df, str(tmp_path / "m"))
    fr = read_matrix(spark, paths, carry=["k"])
    assert sorted((r["k"], r["label"], r["f_0"]) for r in fr.df.collect()) == sorted((c.strip(), 1.0, 1.5) for c in cells)


def test_missing_cells_have_no_class(spark, write_lines):
    path = write_lines(["a,b,Y", "1,2,0", "bad,2,0", "3,,1"])
    model = LinearModel(("a", "b"), (1.0, 1.0))
    for packed in (False, True):
        scored = score(read_matrix(spark, path, on_error="null", packed=packed), model)
        assert sorted(str(r["prediction"]) for r in scored.collect()) == ["1.0", "None", "None"]
        assert accuracy(scored).first()["unscored"] == 2
