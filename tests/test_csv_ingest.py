"""CSV edge cases (FIXTURES.md section 2)."""

import math

import pytest

from glmframe.sources.csv_matrix import column_profile, duplicate_columns, read_header, read_matrix


@pytest.fixture(params=[False, True], ids=["wide", "packed"])
def rm(request):
    """read_matrix in either layout (two different parse plans, same rules)."""

    def read(*args, **kwargs):
        return read_matrix(*args, packed=request.param, **kwargs)

    return read


def test_cells_are_trimmed(spark, write_lines, rm):
    path = write_lines(["a,b,Y", " 2,7 ,1", "\t3\t, 4,0"])
    fr = rm(spark, path)
    assert fr.feature_names == ("a", "b")
    assert sorted(tuple(r) for r in fr.to_wide().df.select("label", "f_0", "f_1").collect()) == [(0.0, 3.0, 4.0), (1.0, 2.0, 7.0)]


def test_quoted_comma_in_ignored_column_is_one_cell(spark, write_lines, rm):
    path = write_lines(["k,a,Y", '"1,5",2,1'])
    fr = rm(spark, path, ignore="k", carry=["k"])
    assert fr.feature_names == ("a",)
    assert [tuple(r) for r in fr.to_wide().df.select("k", "f_0").collect()] == [("1,5", 2.0)]


def test_doubled_and_backslash_quotes(spark, write_lines, rm):
    path = write_lines(["k,a,Y", '"q""q",1,0', '"esc\\"q",2,1'])
    fr = rm(spark, path, carry=["k"])
    assert sorted(r["k"] for r in fr.to_wide().df.collect()) == ['esc"q', 'q"q']


def test_duplicate_header_reads_last_column(spark, write_lines, caplog, rm):
    path = write_lines(["a,b,a,Y", "1,2,3,1", "4,5,6,0"])
    with caplog.at_level("WARNING"):
        fr = rm(spark, path)
    assert "Duplicate column names: a" in caplog.text
    assert fr.feature_names == ("a", "b", "a")
    got = sorted(tuple(r) for r in fr.to_wide().df.select("f_0", "f_1", "f_2").collect())
    assert got == [(3.0, 2.0, 3.0), (6.0, 5.0, 6.0)]
    dups = [tuple(r) for r in duplicate_columns(spark, path).collect()]
    assert dups == [("a", 2)]


def test_every_file_may_start_with_the_header(spark, write_lines, rm):
    path = write_lines(["a,Y", "1,1", "2,0"], ["a,Y", "3,1"])
    fr = rm(spark, path)
    assert sorted(r["f_0"] for r in fr.to_wide().df.collect()) == [1.0, 2.0, 3.0]


def test_header_repeated_mid_file_with_other_spacing(spark, write_lines, rm):
    path = write_lines(["a,b,Y", "1,2,1", " a , b ,Y", "3,4,0", "a,b,Y,extra"])
    fr = rm(spark, path, on_error="null")
    vals = [(r["f_0"], r["f_1"]) for r in fr.to_wide().df.collect()]
    # the line with a surplus cell is not the header: it is kept (and fails to parse)
    assert sorted(vals, key=repr) == sorted([(1.0, 2.0), (3.0, 4.0), (None, None)], key=repr)


def test_true_false_any_case(spark, write_lines, rm):
    path = write_lines(["a,Y", "true,TRUE", "FALSE,false", "True,0"])
    got = sorted(tuple(r) for r in rm(spark, path).to_wide().df.collect())
    assert got == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("bad", ["t", "yes", "", "abc", "nan", "inf", "Inf", "-inf", "NAN"])
def test_not_a_number_fails(spark, write_lines, bad, rm):
    path = write_lines(["a,Y", "1,1", f"{bad},0"])
    with pytest.raises(Exception, match="not a number"):
        rm(spark, path).to_wide().df.collect()


def test_not_a_number_as_null_when_asked(spark, write_lines, rm):
    path = write_lines(["a,Y", "abc,1"])
    assert rm(spark, path, on_error="null").to_wide().df.first()["f_0"] is None


def test_java_number_forms(spark, write_lines, rm):
    cells = ["1d", "0x1p3", "NaN", "Infinity", "1e3", "+3", "-Infinity", "1.5f"]
    path = write_lines(["a,Y"] + [f"{c},0" for c in cells])
    got = [r["f_0"] for r in rm(spark, path).to_wide().df.collect()]
    assert sum(math.isnan(v) for v in got) == 1
    assert sorted(v for v in got if not math.isnan(v)) == [float("-inf"), 1.0, 1.5, 3.0, 8.0, 1000.0, float("inf")]


def test_blank_line_and_short_row_fail(spark, write_lines, rm):
    for bad in ["", "5"]:
        path = write_lines(["a,b,Y", "1,2,1", bad])
        with pytest.raises(Exception, match="not a number"):
            rm(spark, path).to_wide().df.collect()


def test_surplus_cells_are_unread(spark, write_lines, rm):
    path = write_lines(["a,Y", "1,1,zzz,9"])
    assert tuple(rm(spark, path).to_wide().df.first()) == (1.0, 1.0)


def test_target_missing_from_header(spark, write_lines, rm):
    path = write_lines(["a,b", "1,2"])
    with pytest.raises(KeyError):
        rm(spark, path)


def test_empty_target_means_label_zero(spark, write_lines, rm):
    path = write_lines(["a,Y", "1,1", "2,1"])
    fr = rm(spark, path, target="")
    assert fr.feature_names == ("a", "Y")
    assert {r["label"] for r in fr.to_wide().df.collect()} == {0.0}


def test_ignore_list_is_trimmed(spark, write_lines, rm):
    path = write_lines(["a,b,c,Y", "1,2,3,1"])
    assert rm(spark, path, ignore=" a , ,b").feature_names == ("c",)


def test_first_n_counted_after_ignore(spark, write_lines, rm):
    path = write_lines(["a,b,c,d,Y", "1,2,3,4,1"])
    fr = rm(spark, path, ignore="a", max_features=2)
    assert fr.feature_names == ("b", "c")
    assert tuple(fr.to_wide().df.first()) == (1.0, 2.0, 3.0)


def test_header_and_column_profile(spark, write_lines, rm):
    path = write_lines(["x, y ,Y", "1,,1", "2,3,0"])
    assert read_header(spark, path) == ["x", "y", "Y"]
    prof = sorted(tuple(r) for r in column_profile(spark, path).collect())
    assert prof == [(0, "x", 2), (1, "y", 1), (2, "Y", 2)]


def test_header_from_first_non_empty_file(spark, tmp_path, rm):
    folder = tmp_path / "withempty"
    folder.mkdir()
    (folder / "part-00000.csv").write_text("")
    (folder / "part-00001.csv").write_text("a,Y\n1,1\n")
    (folder / "part-00002.csv").write_text("a,Y\n2,0\n")
    fr = rm(spark, str(folder))
    assert fr.feature_names == ("a",)
    assert sorted(r["f_0"] for r in fr.to_wide().df.collect()) == [1.0, 2.0]
