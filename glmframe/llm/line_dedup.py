"""Line dedup (operator 5): winnowing over line hashes.

Lines are split at newlines and compared without the white space around them;
blank lines take no part. A run of consecutive lines counts if it has ``run``
lines, or fewer with ``short_words`` words in all; the shortest such runs are
the windows.

1. Winnowing: in every window the line with the smallest hash (the rightmost of
   equal ones) is its fingerprint. Equal windows choose the same line, so a
   repeated run has a fingerprint in common with its first copy.
2. Positions are joined by fingerprint: those whose fingerprint stands at one
   position only, which are most, go no further.
3. A matched position is extended to both sides, to each window that chose it.
   Extensions that are equal line by line (``left`` and ``right`` lines beside
   the fingerprint, and a hash over all of them) are joined with their first
   place: smaller id, or the same document further up.
4. Later extensions are repeated; where they overlap or touch they make up
   maximal runs, whose lines are deleted. Runs are judged on the input, so the
   first copy of every run stays.

Keys that a thousandth of all rows or more have are joined apart, as a
broadcast table of at most a thousand; no line, however common, gathers its
rows in one task. Work is linear in a text's lines.

Defined cases: null text stays null and empty text empty, with no lines;
documents with fewer lines than a run lose nothing but short runs of enough
words; rows with one id are one place (equal rows are treated alike); null ids
come first. Other columns, whatever their names, pass untouched. Equality is
equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, checkpointed, with_row

RUN_LINES = 3
#: Words (between white space) that a repeated run of fewer lines needs.
SHORT_WORDS = 5
#: White space removed around a line before it is compared (fixed value).
_BLANKS = " \t\x0b\x0c\r"
#: Keys with more than this share's inverse of all rows are joined by broadcast; there are fewer than so many.
HOT_KEYS = 1000


def _line_keys(text: Column) -> Column:
    """(at, key, words) of every line that isn't blank, in order."""
    lines = F.split(text, "\n")
    keyed = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(_BLANKS)).alias("line")))
    full = F.filter(keyed, lambda x: x["line"] != "")
    return F.transform(
        full,
        lambda x: F.struct(
            x["at"].alias("at"),
            F.xxhash64(x["line"]).alias("key"),
            F.size(F.split(x["line"], f"[{_BLANKS}]+")).alias("words"),
        ),
    )


def _windows(run: int) -> Column:
    """Per window of 1 to ``run`` lines: its first line, and the keys, words and numbers of its lines.

    Lines are only picked here, each by its place (a slice would copy all of them for every window): what is
    reckoned from them waits until a window has a row of its own, as functions of lambda variables aren't compiled.
    """

    def windows_of(n: int) -> Column:
        def picked(i: Column, name: str) -> Column:
            return F.array(*(F.get("lines", i + k)[name] for k in range(n)))

        starts = F.when(F.size("lines") >= n, F.sequence(F.lit(0), F.size("lines") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.struct(i.alias("first"), picked(i, "key").alias("keys"), picked(i, "words").alias("words"), picked(i, "at").alias("at"))
        )

    return F.concat(*(windows_of(n) for n in range(1, run + 1)))


def _chosen(each: DataFrame, run: int, short_words: int) -> DataFrame:
    """Per window that counts: fingerprint and its place, lines to its left and right, hash, first line, line numbers.

    Places count the lines that aren't blank, ``at`` numbers all of them.
    """
    size, mark = F.size("w.keys"), F.array_min("w.keys")
    words = sum((F.coalesce(F.get("w.words", F.lit(k)), F.lit(0)) for k in range(run)), F.lit(0))
    left = (size - F.array_position(F.reverse("w.keys"), mark)).cast("int")
    counted = each.where((size == run) | (words >= short_words))
    found = counted.select("id", "copy", mark.alias("mark"), left.alias("left"), size.alias("size"), F.xxhash64("w.keys").alias("hash"), "w.first", "w.at")
    place, right = F.col("first") + F.col("left"), F.col("size") - 1 - F.col("left")
    return found.select("id", "copy", "mark", place.alias("place"), "left", right.alias("right"), "hash", "first", "at")


def _join_repeated(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows with a key of ``found`` (its ``n`` is the key's number of rows), common keys by broadcast."""
    hot = F.broadcast(found.where(F.col("n") > F.lit(max(1, total // HOT_KEYS))).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(found.drop("n"), keys)
    return rows.join(hot, keys).unionByName(rest)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their deleted lines."""
    for batch in batches:
        texts, n_lines, n_removed, lists = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n_lines.append(sum(1 for x in lines if x.strip(_BLANKS)))
            lists.append(sorted(gone or ()))
            n_removed.append(len(lists[-1]))
            if gone:
                taken = set(gone)
                text = "\n".join([x for i, x in enumerate(lines) if i not in taken])
            texts.append(text)
        columns = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
        columns.append(pa.array(lists, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *columns], names=["row", "text", "n_lines", "n_removed", "removed"]
        )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    run: int = RUN_LINES,
    short_words: int = SHORT_WORDS,
) -> DataFrame:
    """Delete every line that a repeated run covers: ``run`` or more lines, or fewer with ``short_words`` words in all.

    Returns ``row`` (a struct of the columns of ``docs`` but the text), ``text``
    without the deleted lines, ``n_lines`` (blank ones not counted),
    ``n_removed`` and ``removed`` (the deleted lines' numbers, from 0, blank
    lines counted).
    """
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    rows = bound_batches(docs).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*others).alias("row")
    ).withColumn("copy", F.xxhash64("text"))

    # winnowing: every window with the position that it chooses; a row holds no more than its window
    lines = rows.select("id", "copy", _line_keys(F.col("text")).alias("lines"))
    windows = lines.select("id", "copy", _windows(run).alias("windows"))
    # not explode: it would infer a filter on the windows, which computes a text's lines anew for each of them
    each = windows.select("id", "copy", F.explode_outer("windows").alias("w")).where("w is not null")
    chosen = checkpointed(_chosen(each, run, short_words))
    total = chosen.count()

    # positions with a fingerprint in common
    spot = F.struct("id", "place")
    marks = chosen.groupBy("mark").agg(F.min(spot).alias("least"), F.max(spot).alias("most"), F.count("*").alias("n"))
    marks = checkpointed(marks.where(~F.col("least").eqNullSafe(F.col("most"))).select("mark", "n"))
    matched = checkpointed(_join_repeated(chosen, marks, ["mark"], total))

    # their extensions, and where each stands first
    whole, begin = ["mark", "left", "right", "hash"], F.struct("id", "first")
    firsts = matched.groupBy(*whole).agg(F.min(begin).alias("least"), F.max(begin).alias("most"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.where(~F.col("least").eqNullSafe(F.col("most"))).drop("most"))
    later = _join_repeated(matched, firsts, whole, matched.count()).where(~begin.eqNullSafe(F.col("least")))
    gone = later.select("id", "copy", F.explode("at").alias("line"))
    gone = gone.groupBy("id", "copy").agg(F.collect_set("line").alias("removed"))

    found = rows.alias("d").join(
        gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.copy") == F.col("g.copy")), "left"
    ).select("row", "text", "removed")
    return found.mapInArrow(_delete, with_row(found, "text string, n_lines long, n_removed long, removed array<int>"))


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; a null text as an empty one)."""
    found = line_dedup(docs.select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), full_lines AS (
  SELECT doc_id, pos, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nr,
         len(string_split_regex(key, '[ \\t\\x0b\\x0c\\r]+')) AS words
  FROM keyed WHERE key <> ''
), sized AS (
  {" UNION ALL ".join(f"SELECT {n} AS size, doc_id, nr, list(key) OVER w{n} AS keys, sum(words) OVER w{n} AS words FROM full_lines WINDOW w{n} AS (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in range(1, RUN_LINES + 1))}
), ranked AS (
  SELECT doc_id, nr, size, row_number() OVER (PARTITION BY keys ORDER BY doc_id, nr) AS place
  FROM sized WHERE len(keys) = size AND (size = {RUN_LINES} OR words >= {SHORT_WORDS})
), gone AS (
  SELECT DISTINCT r.doc_id, l.pos FROM ranked r JOIN full_lines l
    ON l.doc_id = r.doc_id AND l.nr BETWEEN r.nr AND r.nr + r.size - 1
  WHERE r.place > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id,
       (SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
