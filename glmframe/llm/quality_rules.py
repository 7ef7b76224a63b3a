"""Quality rules (operator 2): a short-circuit cascade of native expressions.

``order_rules`` measures the rules on a bounded sample, fetched once: which rows
each rejects, and the seconds its expressions take on a local batch that holds
the sample many times. Rules are then chosen one after another by rejection
per cost, among the rows that those before have left; what a later rule needs
is computed only for rows that no earlier one has rejected. The order changes
the time and ``failed_rule``, never ``kept``.

A text without enough words or mostly made of repeated ones fails whatever the
rules are. The first is asked before any rule, the second has its place in the
cascade like any rule; both are named ``base``.

Everything is DataFrame functions, in one pass without a shuffle. Words are
split once and three-word windows are hashed; where a text has equal hashes,
(hash, position) packed in one long are sorted to find which windows these
are. The packed hash keeps all 64 bits but those the position needs.

Defined cases: null, empty and white-space texts have no words and are
rejected for it; equal rows get equal verdicts; other columns, whatever their
names, pass untouched inside ``row``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sample: so many rows at most, of texts of so many characters at most (they only set the order).
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000
#: How often the timed batch holds the sample.
REPEATS = 2
#: Space and 0x09-0x0D, between words (fixed value).
_SPACES = " \t\n\x0b\x0c\r"
#: Characters counted as symbols (fixed value).
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A text without enough words, or mostly made of repeated ones, fails before any rule.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: First characters of list lines, and ends of cut ones (fixed values).
_BULLET, _ELLIPSIS = r"^[-*\x{2022}]", r"(\.\.\.|\x{2026})$"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over measures, true for a bad row; ``uses`` names the measures' groups."""

    name: str
    uses: tuple[str, ...]
    rejects: str


FEW_WORDS = Rule("base", ("words",), "n_words < 50")
MOSTLY_REPEATED = Rule("base", ("words", "repeats"), "100 * n_repeat_words > 50 * n_words")
RULES = (
    Rule("symbols", ("words", "symbols"), "10 * n_symbols > word_chars"),
    Rule("word_length", ("words",), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", ("lines",), "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("repeated_words", ("words", "repeats"), "3 * n_repeat_words > n_words"),
    Rule("capitals", ("words", "capitals"), "2 * n_capitals > word_chars"),
    Rule("bullet_lines", ("lines",), "n_lines >= 4 and 10 * n_bullets > 9 * n_lines"),
    Rule("ellipsis_lines", ("lines",), "n_lines >= 4 and 10 * n_ellipses > 3 * n_lines"),
    Rule("letters", ("words", "letters"), "5 * n_letterless > n_words"),
    Rule("top_pair", ("words", "pairs"), "n_top_pair >= 5 and 10 * n_top_pair > n_words"),
)


def _dropped(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _words(df: DataFrame, on: Column) -> DataFrame:
    trimmed = F.btrim("text", F.lit(_SPACES))
    none = F.array().cast("array<string>")
    df = df.withColumn("parts", F.when(on, F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))))
    return df.withColumns({"n_words": F.size("parts").cast("long"), "word_chars": F.when(on, _dropped(F.col("text"), _SPACES)).cast("long")})


def _symbols(df: DataFrame, on: Column) -> DataFrame:
    count = F.length("text") - _dropped(F.col("text"), _SYMBOLS)
    return df.withColumn("n_symbols", F.when(on, count).cast("long"))


def _capitals(df: DataFrame, on: Column) -> DataFrame:
    count = F.length("text") - _dropped(F.col("text"), _CAPITALS)
    return df.withColumn("n_capitals", F.when(on, count).cast("long"))


def _lines(df: DataFrame, on: Column) -> DataFrame:
    full = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    df = df.withColumn("lines", F.when(on, full))
    n = F.size("lines").cast("long")
    matching = lambda pattern: F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(_SPACES)).rlike(pattern))).cast("long")
    counts = {"n_dup_lines": n - F.size(F.array_distinct("lines")), "n_bullets": matching(_BULLET), "n_ellipses": matching(_ELLIPSIS)}
    return df.withColumns({"n_lines": n, **counts}).drop("lines")


def _letters(df: DataFrame, on: Column) -> DataFrame:
    """Words without a letter."""
    count = F.size(F.filter("parts", lambda x: ~x.rlike(r"\p{L}")))
    return df.withColumn("n_letterless", F.when(on, count).cast("long"))


def _pairs(df: DataFrame, on: Column) -> DataFrame:
    """How often the most frequent pair of neighbouring words stands in the text: the longest run of sorted hashes."""
    n = F.size("parts") - 1
    twos = F.arrays_zip(F.slice("parts", 1, n).alias("a"), F.slice("parts", 2, n).alias("b"))
    df = df.withColumn("ranked", F.when(on & (n > 0), F.sort_array(F.transform(twos, lambda x: F.xxhash64(x)))))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    most = F.aggregate("ranked", start, step, lambda s: s["most"])
    return df.withColumn("n_top_pair", F.when(on, F.coalesce(most, F.lit(0).cast("long")))).drop("ranked")


def _repeats(df: DataFrame, on: Column) -> DataFrame:
    """Words within three-word windows that the text has twice or more; each step is null where none is needed."""
    n = F.size("parts") - 2
    three = [F.slice("parts", k, n).alias(f"w{k}") for k in (1, 2, 3)]
    df = df.withColumn("hashes", F.when(on & (n > 1), F.transform(F.arrays_zip(*three), lambda x: F.xxhash64(x))))
    df = df.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    df = df.withColumn("bits", F.ceil(F.log2(F.size("hashes") + 1)).cast("int"))
    left = lambda x: F.call_function("shiftleft", x, F.col("bits"))
    pack = F.transform("hashes", lambda h, i: left(h).bitwiseOR(i.cast("long")))
    df = df.withColumn("ranked", F.when(F.col("again"), F.sort_array(pack)))
    k = F.size("hashes") - 1
    twos = F.arrays_zip(F.slice("ranked", 1, k).alias("a"), F.slice("ranked", 2, k).alias("b"))
    apart = lambda x: F.call_function("shiftright", x["a"].bitwiseXOR(x["b"]), F.col("bits"))
    df = df.withColumn("equal", F.filter(twos, lambda x: apart(x) == 0))
    place = left(F.lit(1).cast("long")) - 1
    first = F.transform("equal", lambda x: x["a"].bitwiseAND(place))
    second = F.transform("equal", lambda x: x["b"].bitwiseAND(place))
    df = df.withColumn("places", F.sort_array(F.array_union(first, second)))
    # a window at sorted place p covers min(3, next p - p) words that the next doesn't, the last one three
    m = F.size("places") - 1
    steps = F.arrays_zip(F.slice("places", 1, m).alias("a"), F.slice("places", 2, m).alias("b"))
    words = F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + F.least(F.lit(3).cast("long"), x["b"] - x["a"]))
    df = df.withColumn("n_repeat_words", F.when(on, F.when(m >= 0, words).otherwise(F.lit(0).cast("long"))))
    return df.drop("hashes", "again", "bits", "ranked", "equal", "places")


#: Measures by group, each computed only where its second argument holds.
_GROUPS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "words": _words,
    "symbols": _symbols,
    "lines": _lines,
    "repeats": _repeats,
    "capitals": _capitals,
    "letters": _letters,
    "pairs": _pairs,
}


def _measured(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for group in dict.fromkeys(g for rule in rules for g in rule.uses):
        df = _GROUPS[group](df, F.lit(True))
    return df


def order_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected rows per second, each among the rows that those before it leave.

    At most ``rows`` texts are fetched (from the first partitions that have
    enough), and timed as a local batch; nothing but the order depends on them.
    """
    rules, spark = list(rules), docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    taken = docs.select(text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(rows)
    if not taken or not rules:
        return rules
    # kept in memory, so that the rules run as in any job, not while the plan of a local table is made
    batch = spark.createDataFrame(taken, "text string").coalesce(1).persist()
    many = batch.select(F.explode(F.array_repeat("text", REPEATS)).alias("text")).persist()

    def seconds(some: Sequence[Rule]) -> float:
        df, found = _measured(many, some), F.lit(False)
        for rule in some:
            found = F.expr(rule.rejects)
        began = time.perf_counter()
        df.agg(F.count_if(found), F.sum(F.length("text"))).collect()
        return time.perf_counter() - began

    try:
        hits = _measured(batch, rules).select(*(F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules)).collect()
        seconds([])
        nothing = seconds([])
        # the second time counts: code is compiled by then
        cost = {i: max(min(seconds([r]), seconds([r])) - nothing, 1e-3) for i, r in enumerate(rules)}
    finally:
        many.unpersist()
        batch.unpersist()
    left, order, open_ = range(len(hits)), [], set(cost)
    while open_:
        rejected = {i: sum(hits[k][i] for k in left) for i in open_}
        best = max(sorted(open_), key=lambda i: (rejected[i] + 0.5) / cost[i])
        order.append(rules[best])
        open_.remove(best)
        left = [k for k in left if not hits[k][best]]
    return order


def quality_rules(
    docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, counted: bool = False
) -> DataFrame:
    """``row`` (a struct of the columns but the text), ``failed_rule`` (null: none) and ``kept``.

    ``rules`` run in their order; without any given, all of ``RULES`` by
    ``order_rules``. ``kept`` is the same for any order, and with or without
    ``counted``, which gives the base measures of every row too (n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); without
    it nothing is computed that the verdict doesn't need.
    """
    if rules is None:
        rules = order_rules(docs, text_col, RULES if counted else (*RULES, MOSTLY_REPEATED))
    elif not counted:
        rules = (*rules, MOSTLY_REPEATED)
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    df = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    every, ready = F.lit(True), {"words"}
    df = _words(df, every)
    if counted:
        for group in ("symbols", "lines", "repeats"):
            df = _GROUPS[group](df, every)
        ready |= {"symbols", "lines", "repeats"}
        df = df.withColumn("base_failed", F.expr(BASE))
    first = F.col("base_failed") if counted else F.expr(FEW_WORDS.rejects)
    df = df.withColumn("failed_rule", F.when(first, F.lit(FEW_WORDS.name)))
    for rule in rules:
        on = F.col("failed_rule").isNull()
        for group in rule.uses:
            if group not in ready:
                df, ready = _GROUPS[group](df, on), ready | {group}
        df = df.withColumn("failed_rule", F.when(on & F.expr(rule.rejects), F.lit(rule.name)).otherwise(F.col("failed_rule")))
    df = df.withColumn("kept", F.col("failed_rule").isNull())
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select("row", *(base if counted else []), "failed_rule", "kept")


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every document."""
    found = quality_rules(docs.select("doc_id", "text"), counted=True)
    return found.select("row.doc_id", *(c for c in found.columns if c not in ("row", "failed_rule")))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM base)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY doc_id
), pairs AS (
  SELECT doc_id, max(n) AS n FROM (
    SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, count(*) AS n
    FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM base) GROUP BY ALL
  ) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipses,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless,
         coalesce(p.n, 0) AS n_top_pair
  FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id LEFT JOIN pairs p ON p.doc_id = b.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR 3 * n_repeat_words > n_words OR 2 * n_capitals > word_chars
            OR (n_lines >= 4 AND 10 * n_bullets > 9 * n_lines) OR (n_lines >= 4 AND 10 * n_ellipses > 3 * n_lines)
            OR 5 * n_letterless > n_words OR (n_top_pair >= 5 AND 10 * n_top_pair > n_words)) AS kept
FROM judged
"""
