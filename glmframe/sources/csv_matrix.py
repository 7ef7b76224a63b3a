"""Labelled-matrix CSV source: text lines -> FeatureFrame.

Rules kept from the command-line tool this library replaces:

* one text line is one record (no multi-line records); comma separated, quote
  ``"``; a quote inside a quoted cell is written ``""`` or ``\\"``; leading
  white space before a cell is ignored and every cell is trimmed;
* the first line of the first input file (in path order) names the columns;
  every line equal to that header, anywhere in any file, is dropped, so a
  folder of files that each start with the header reads correctly;
* a repeated column name is allowed (a warning is logged); every feature of
  that name reads the *last* column of that name;
* the target column (default ``Y``) becomes ``label``; with no target the
  label is 0.0; ignored names and the target are removed, then only the first
  ``max_features`` remain;
* a cell is a Java double literal, else ``true``/``false`` in any case, else
  the job fails (``on_error='null'`` keeps going with NULL).

Physical plan: ``text`` scan -> one array of cells per line -> projection of
the needed positions; the same parse whatever the number of columns. Nothing
but the single header line reaches the driver.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glmframe.frame import LABEL, PACKED, FeatureFrame, build_frame, parse_option_list, split_roles
from glmframe.functions.numeric import lenient_number, trim_cell

log = logging.getLogger(__name__)

# Parser settings of the matrix CSV format.
SEPARATOR = ","
QUOTE = '"'
DOUBLED_QUOTE = '""'
BACKSLASH_MARK = "\ue000"  # a private-use character (trimming leaves it): stands for an escaped backslash while a line is split

# Pass-through columns that remember where a line came from (input order).
ORDER_COLS = ("_src_file", "_src_block")


def _normalised_line(value: Column) -> Column:
    """Backslash escapes as the field pattern reads them.

    An escaped backslash is marked, an escaped quote doubled, and a backslash
    before anything else dropped; runs of backslashes pair up from the left.
    """
    value = F.regexp_replace(value, r"\\\\", BACKSLASH_MARK)
    value = F.regexp_replace(value, r'\\"', DOUBLED_QUOTE)
    return F.translate(value, "\\", "")


# Characters dropped by the header-line pre-check: blanks, quote, backslash.
SQUEEZE_CHARS = "".join(chr(i) for i in range(0x21)) + '"' + "\\"


def _squeeze_text(text: str) -> str:
    return "".join(ch for ch in text if ch not in SQUEEZE_CHARS)


def _squeezed(line: Column) -> Column:
    return F.translate(line, SQUEEZE_CHARS, "")


# Fixed value: parts of the header that a line is searched for.
HEADER_PARTS = 4


def _may_be_header(line: Column, header: Sequence[str]) -> Column:
    """False for most data lines, true for every header line; the costly test comes last.

    Parts of a name without blanks, quotes and backslashes are in a header line as they
    are, unless it has backslashes that the parse drops.
    """
    blanked = "".join(" " if ch in SQUEEZE_CHARS else ch for ch in " ".join(header))
    parts = set(blanked.split(" "))
    longest = sorted(parts, key=lambda p: (-len(p), p))[:HEADER_PARTS]
    held = reduce(and_, [F.contains(line, F.lit(p)) for p in longest])
    return (held | _any_of(line, "\\")) & (_squeezed(line) == F.lit(_squeeze_text(SEPARATOR.join(header))))


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _input_files_in_order(spark: SparkSession, path: str | Sequence[str]):
    """Input files in path order, as a JVM set (listing only; no data is read, no name crosses to Python)."""
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(spark.read.text(_paths(path))._jdf.inputFiles())
    return jvm.java.util.TreeSet(jvm.scala.jdk.javaapi.CollectionConverters.asJava(names.toSeq()))


def _literal_path(name: str) -> str:
    """A path as Spark's readers take it literally: glob characters escaped."""
    return "".join("\\" + ch if ch in "{}[]*?\\" else ch for ch in name)


def first_line(spark: SparkSession, path: str | Sequence[str]) -> str | None:
    """The first line of the first non-empty file; None without any line.

    Empty files are skipped by their metadata; file names cross to Python one
    at a time, and only until a line is found.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = _input_files_in_order(spark, path)
    while not files.isEmpty():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files.pollFirst()))
        if file.getFileSystem(conf).getFileStatus(file).getLen() == 0:
            continue
        rows = spark.read.text(_literal_path(file.toString())).limit(1).collect()
        if rows:
            return rows[0][0]
    return None


def read_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Trimmed column names from the first line of the first non-empty input
    file (path order), parsed like any other line: any number of names."""
    line = first_line(spark, path)
    if line is None:
        raise ValueError(f"no line in any input file under {path!r}: no header")
    return list(spark.range(1).select(cell_array(F.lit(line)).alias("c")).first()["c"])


def duplicate_names(names: Sequence[str]) -> dict[str, int]:
    """Names that occur more than once, with their count, in first-seen order."""
    counts: dict[str, int] = {}
    for n in names:
        counts[n] = counts.get(n, 0) + 1
    return {n: k for n, k in counts.items() if k > 1}


# One field of a line with the separator that ends it: a quoted text (quotes
# doubled inside) between blanks, or a quoted text that never ends, or any run
# without a separator. The line gets one separator appended, so every field
# (also an empty one) is a non-empty match. Possessive loops only: matching
# needs no stack, however long a cell is.
_QUOTED = r'\s*+"[^"]*+(?:""[^"]*+)*+'
FIELD_PATTERN = rf'(?s){_QUOTED}"\s*+,|{_QUOTED}\z|[^,]*+,'
QUOTED_PATTERN = r'(?s)^"(.*?)"?$'
# Characters that a line needs more than a split for.
ODD_PATTERN = rf'[\x00-\x1f"\\{BACKSLASH_MARK}]'


def _any_of(text: Column, *chars: str) -> Column:
    """Whether the text holds one of the characters (a byte search each, no pattern)."""
    return reduce(or_, [F.contains(text, F.lit(ch)) for ch in chars])


def cell_array(line: Column) -> Column:
    """All cells of a line as ``ARRAY<STRING>``: trimmed, unquoted, ``""`` -> ``"``.

    The plan is the same size for any number of cells (one regex extraction
    and one lambda), which keeps very wide matrices cheap to plan and compile.
    A line without quotes, backslashes and control characters (most are) is just
    split, and rid of blanks if it has any, which is much cheaper.
    """
    raw = F.split(line, SEPARATOR)
    plain = F.when(_any_of(line, " "), F.transform(raw, lambda c: F.trim(c))).otherwise(raw)
    return (
        F.when(~line.rlike(ODD_PATTERN), plain)
        .when(_any_of(line, QUOTE, "\\", BACKSLASH_MARK), _quoted_cells(line))
        .otherwise(F.transform(raw, trim_cell))
    )


def _quoted_cells(line: Column) -> Column:
    """The cells of any line, by the field pattern."""
    raw = F.regexp_extract_all(F.concat(_normalised_line(line), F.lit(SEPARATOR)), F.lit(FIELD_PATTERN), 0)

    def clean(c: Column) -> Column:
        t = trim_cell(F.substring(c, F.lit(1), F.length(c) - 1))
        inner = F.regexp_replace(F.regexp_extract(t, QUOTED_PATTERN, 1), DOUBLED_QUOTE, QUOTE)
        return F.translate(F.when(t.startswith(QUOTE), trim_cell(inner)).otherwise(t), BACKSLASH_MARK, "\\")

    return F.transform(raw, clean)


def parse_lines(lines: DataFrame, header: Sequence[str], keep_order: bool = False) -> DataFrame:
    """Lines (column ``value``) as one ``_cells`` array of trimmed text each, header lines removed.

    With ``keep_order`` (file scans only) the source file and split start are
    carried (see ``ORDER_COLS``). Works on a streaming DataFrame too: it is a
    stateless projection and filter.
    """
    extra: list[Column] = []
    if keep_order:
        extra = [
            F.col("_metadata.file_path").alias(ORDER_COLS[0]),
            F.col("_metadata.file_block_start").alias(ORDER_COLS[1]),
        ]
    parsed = lines.select(F.col("value").alias("line"), cell_array(F.col("value")).alias("_cells"), *extra)
    candidate = _may_be_header(F.col("line"), header)
    exact = F.col("_cells") == F.from_json(F.lit(json.dumps(list(header))), "array<string>")
    return parsed.where(~(candidate & exact)).drop("line")


def matrix_from_cells(
    cells: DataFrame,
    header: Sequence[str],
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    on_error: str = "raise",
    carry: Sequence[str] = (),
    keep_order: bool = False,
    packed: bool = False,
    carry_prefix: str = "",
) -> FeatureFrame:
    """Role split and number parsing of ``_cells`` arrays (see :func:`read_matrix`).

    Only the needed positions are read. Packed features are one ``transform``
    over the array of source positions, a single literal.
    """
    target = target or None
    ignore_set = parse_option_list(ignore) | set(carry)
    label_pos, names, positions = split_roles(header, target, ignore_set, max_features)
    carry_pos = {c: split_roles(header, c)[0] for c in carry}
    arr = F.col("_cells")
    if label_pos is None:
        label = F.lit(0.0)
    else:
        label = lenient_number(
            F.get(arr, label_pos), on_error=on_error, what=f"column {header[label_pos]}", trimmed=True
        )
    order_cols = list(ORDER_COLS) if keep_order else []
    carried = [F.get(arr, carry_pos[c]).alias(carry_prefix + c) for c in carry] + [F.col(c) for c in order_cols]
    if not packed:
        exprs = [
            lenient_number(F.get(arr, p), on_error=on_error, what=f"column {header[p]}", trimmed=True) for p in positions
        ]
        return build_frame(cells, label, exprs, names, carried, False)
    pos_arr = F.from_json(F.lit(json.dumps(positions)), "array<int>")
    feats = F.transform(
        pos_arr, lambda p: lenient_number(F.get(arr, p), on_error=on_error, what="a feature column", trimmed=True)
    )
    out = cells.select(label.alias(LABEL), feats.alias(PACKED), *carried)
    return FeatureFrame(out, tuple(names), tuple(out.columns[2:]), True)


def parsed_cells(
    spark: SparkSession, path: str | Sequence[str], header: Sequence[str], keep_order: bool = False
) -> DataFrame:
    """Text cells of every data line under ``path`` (see :func:`parse_lines`)."""
    return parse_lines(spark.read.text(_paths(path)), header, keep_order)


def read_matrix(
    spark: SparkSession,
    path: str | Sequence[str],
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    on_error: str = "raise",
    keep_order: bool = False,
    carry: Sequence[str] = (),
    packed: bool = False,
    carry_prefix: str = "",
) -> FeatureFrame:
    """Read a labelled numeric matrix from CSV text files (file, folder or glob).

    ``target=None`` or ``""`` means no label column (label 0.0 everywhere).
    ``ignore`` is a set of names or comma separated text. ``max_features`` of
    0 or None keeps all. ``carry`` names raw columns to pass through as text
    (row keys for keyed predictions); they are also excluded from features.
    ``keep_order`` carries the input position for an input-order row index.
    ``packed`` chooses the one-array layout (right for hundreds of features or
    more); the parse is the same. ``carry_prefix`` is put before carried names.
    """
    header = read_header(spark, path)
    lines = spark.read.text(_paths(path))
    return matrix_from_lines(lines, header, target, ignore, max_features, on_error, carry, keep_order, packed, carry_prefix)


def matrix_from_lines(
    lines: DataFrame,
    header: Sequence[str],
    target: str | None = "Y",
    ignore: str | Iterable[str] = (),
    max_features: int | None = None,
    on_error: str = "raise",
    carry: Sequence[str] = (),
    keep_order: bool = False,
    packed: bool = False,
    carry_prefix: str = "",
) -> FeatureFrame:
    """Lines (column ``value``, batch or streaming) -> FeatureFrame."""
    header = list(header)
    dups = duplicate_names(header)
    if dups:
        log.warning("Duplicate column names: %s", ", ".join(dups))
    cells = parse_lines(lines, header, keep_order=keep_order)
    return matrix_from_cells(
        cells, header, target, ignore, max_features, on_error, carry, keep_order, packed, carry_prefix
    )


def column_names(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The header as a small DataFrame ``(position INT, name STRING)``."""
    header = read_header(spark, path)
    return spark.createDataFrame(list(enumerate(header)), "position INT, name STRING")


def column_profile(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(position, name, non_empty)``: the header with the number of data
    lines that have a non-empty cell in that column (one aggregate pass)."""
    header = read_header(spark, path)
    cells = parse_lines(spark.read.text(_paths(path)), header)
    filled = (
        cells.select(F.posexplode("_cells").alias("position", "cell"))
        .groupBy("position")
        .agg(F.count_if(F.col("cell") != "").alias("non_empty"))
    )
    names = column_names(spark, path).alias("h")
    return names.join(filled.alias("f"), F.col("h.position") == F.col("f.position"), "left").select(
        "h.position", "name", F.coalesce("non_empty", F.lit(0)).alias("non_empty")
    )


def duplicate_columns(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header names that occur more than once: ``(name, occurrences)``."""
    return (
        column_names(spark, path)
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def _quoted_text(text: str) -> str:
    plain = not any(ch in text for ch in ',"\\')
    return text if plain else '"' + text.replace("\\", "\\\\").replace('"', DOUBLED_QUOTE) + '"'


def _quoted(text: Column) -> Column:
    cell = F.regexp_replace(text, "[\r\n]+", " ")
    inner = F.replace(F.replace(cell, F.lit("\\"), F.lit("\\\\")), F.lit(QUOTE), F.lit(DOUBLED_QUOTE))
    quoted = F.when(cell.rlike(r'[,"\\]'), F.concat(F.lit(QUOTE), inner, F.lit(QUOTE))).otherwise(cell)
    return F.when(_any_of(text, SEPARATOR, QUOTE, "\\", "\r", "\n"), quoted).otherwise(text)


def _cell_text(field: T.StructField) -> Column:
    """A column's cells as the file holds them; the text of a number or a truth value needs no quotes."""
    text = F.coalesce(F.col(f"`{field.name}`").cast("string"), F.lit(""))
    return text if isinstance(field.dataType, (T.NumericType, T.BooleanType)) else _quoted(text)


def write_matrix_csv(
    df: DataFrame, path: str, header: Sequence[str] | None = None, keep_order: bool = False
) -> list[str]:
    """Write a DataFrame as matrix CSV text under ``path``; return the input paths.

    The header (default: the column names, repeats allowed) is written once as
    its own first file and the rows as many part files, each cell as text;
    cells that a reader would split or change are quoted, line breaks become
    blanks (one line is one record). Unless ``keep_order`` is set (rows must
    reach the files in the frame's order, e.g. after ``orderBy``), rows of fewer
    partitions than there are task slots are spread over these first.
    """
    spark = df.sparkSession
    names = list(header) if header is not None else df.columns
    head_dir, rows_dir = f"{path}/0-header", f"{path}/1-rows"
    head = SEPARATOR.join(_quoted_text(n) for n in names)
    spark.createDataFrame([(head,)], "value STRING").coalesce(1).write.text(head_dir)
    slots = spark.sparkContext.defaultParallelism
    if not keep_order and df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)  # before formatting
    cells = [_cell_text(f) for f in df.schema.fields]
    df.select(F.concat_ws(SEPARATOR, *cells).alias("value")).write.text(rows_dir)
    return [head_dir, rows_dir]
