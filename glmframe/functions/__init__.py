"""Column expressions used by the operators (all JVM-side, no Python per row)."""

from glmframe.functions.numeric import (
    boolean_as_number,
    format_fixed,
    lenient_number,
    linear_margin,
    logistic,
    number_or_null,
    threshold_class,
    trim_cell,
)
from glmframe.functions.listing import truncated_listing

__all__ = [
    "boolean_as_number",
    "format_fixed",
    "lenient_number",
    "linear_margin",
    "logistic",
    "number_or_null",
    "threshold_class",
    "trim_cell",
    "truncated_listing",
]
