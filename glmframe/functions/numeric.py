"""Cell-level column expressions: trimming, lenient number parsing, linear scoring.

All of these are plain Catalyst expressions (no Python per row), so they stay
inside whole-stage codegen and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must match the ingest rules): a cell is trimmed of every
# character from U+0000 to U+0020 at both ends; the only accepted words are
# "true" and "false" in any letter case; Java-style special numbers are
# spelled exactly "NaN" and "Infinity", with an optional sign.
TRIM_CHARS = "".join(chr(i) for i in range(0x21))
TRUE_WORD = "true"
FALSE_WORD = "false"
SPECIAL_ANY_CASE = r"^[+-]?(nan|inf|infinity)$"
SPECIAL_EXACT = r"^[+-]?(NaN|Infinity)$"

ON_ERROR_MODES = ("raise", "null")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_cell(c: Column | str) -> Column:
    """Strip control characters and spaces (code points <= 0x20) from both ends."""
    return F.trim(_col(c), F.lit(TRIM_CHARS))


def number_or_null(c: Column | str) -> Column:
    """Parse a trimmed cell as a Java double literal, NULL if it is not one.

    ``try_cast`` already accepts Java forms such as ``1d``, ``1.5f``, ``0x1p3``,
    ``NaN``, ``Infinity`` and ``1e999`` (infinite); it also accepts ``nan`` or
    ``inf`` in any case, which Java does not, so those spellings are turned
    away. The spelling check only runs on a cell with an N, which all of them have.
    """
    t = _col(c)
    with_n = F.contains(t, F.lit("n")) | F.contains(t, F.lit("N"))
    misspelt = with_n & F.lower(t).rlike(SPECIAL_ANY_CASE) & ~t.rlike(SPECIAL_EXACT)
    return F.when(misspelt, F.lit(None).cast("double")).otherwise(t.try_cast("double"))


def boolean_as_number(c: Column | str) -> Column:
    """``true``/``false`` in any case as 1.0/0.0, otherwise NULL.

    Text before "F" (digits, signs) is neither, which spares most cells the lower case.
    """
    low, word = F.lower(_col(c)), _col(c) >= F.lit(FALSE_WORD[0].upper())
    return (
        F.when(word & (low == F.lit(TRUE_WORD)), F.lit(1.0))
        .when(word & (low == F.lit(FALSE_WORD)), F.lit(0.0))
        .otherwise(F.lit(None).cast("double"))
    )


def lenient_number(
    c: Column | str, on_error: str = "raise", what: str = "cell", trimmed: bool = False
) -> Column:
    """A raw text cell as DOUBLE: trimmed, true/false or a number.

    The words come first: no number is spelled so, and a failed number parse costs
    much more than a comparison.

    ``on_error='raise'`` fails the job on anything else (also an empty or
    missing cell), as the ingest rules require; ``'null'`` yields NULL instead.
    ``trimmed`` skips the trim for cells that are trimmed already.
    """
    if on_error not in ON_ERROR_MODES:
        raise ValueError(f"on_error must be one of {ON_ERROR_MODES}, got {on_error!r}")
    t = _col(c) if trimmed else trim_cell(c)
    value = F.coalesce(boolean_as_number(t), number_or_null(t))
    if on_error == "null":
        return value
    message = F.concat(
        F.lit(f"not a number or boolean in {what}: '"), F.coalesce(t, F.lit("<missing>")), F.lit("'")
    )
    return F.coalesce(value, F.raise_error(message).cast("double"))


def linear_margin(
    feature_cols: Sequence[Column | str], weights: Sequence[float], intercept: float = 0.0
) -> Column:
    """``sum_i w_i * x_i + intercept``, summed left to right like a dot product.

    Every term is kept (also zero weights), so a NaN or infinite feature
    propagates the way a dense dot product does.
    """
    if len(feature_cols) != len(weights):
        raise ValueError(f"{len(feature_cols)} feature columns but {len(weights)} weights")
    acc: Column | None = None
    for c, w in zip(feature_cols, weights):
        term = _col(c) * F.lit(float(w))
        acc = term if acc is None else acc + term
    if acc is None:
        acc = F.lit(0.0)
    return acc + F.lit(float(intercept))


def double_array(values: Sequence[float]) -> Column:
    """An ``ARRAY<DOUBLE>`` literal, as one value whatever its length."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def packed_margin(features: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Margin of an ``ARRAY<DOUBLE>`` of features: a left-to-right fold of
    ``x_i * w_i`` (the same order as :func:`linear_margin`) plus intercept.

    The weights are one array literal, so the plan stays small for any
    number of features; the fold is a higher-order function evaluated per
    row without recursion depth limits. Arrays shorter than the model give
    NULL (missing features), like a short row, and so do longer ones.
    """
    w = double_array(weights)
    products = F.zip_with(features, w, lambda x, y: x * y)
    total = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    complete = F.size(features) == F.lit(len(weights))
    return F.when(complete, total + F.lit(float(intercept)))


def logistic(margin: Column) -> Column:
    """The logistic link ``1 / (1 + exp(-margin))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def threshold_class(probability: Column, threshold: float = 0.5) -> Column:
    """1.0 when the probability is strictly above the threshold, else 0.0.

    A NaN probability gives 0.0 (IEEE: NaN is above nothing), whereas Spark's
    own ordering puts NaN above every number, hence the explicit test. A NULL
    probability (a missing feature) gives NULL, never a class.
    """
    above = (probability > F.lit(float(threshold))) & ~F.isnan(probability)
    return F.when(probability.isNotNull(), F.when(above, F.lit(1.0)).otherwise(F.lit(0.0)))


def format_fixed(c: Column | str, digits: int = 6) -> Column:
    """``printf('%.<digits>f')`` text of a double (``%f`` is six digits).

    The two classes have fixed texts, which spares most predictions the formatter.
    """
    value, digits = _col(c), int(digits)
    text = value.cast("string")  # tells 0.0 from -0.0
    classes = F.when(text == F.lit("0.0"), F.lit(f"{0:.{digits}f}")).when(text == F.lit("1.0"), F.lit(f"{1:.{digits}f}"))
    return classes.otherwise(F.format_string(f"%.{digits}f", value))
