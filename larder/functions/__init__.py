"""Column-level helpers shared by the operators; all compile to JVM expressions."""

from larder.functions.numbers import at_least_zero, parse_decimal, ratio
from larder.functions.predicates import (
    contains_text,
    moment,
    number_starts_with,
    trailing_window,
    within_dates,
    without_excluded,
)
from larder.functions.sorting import asc, desc
from larder.functions.texts import (
    load_type_label,
    moment_label,
    order_status_label,
    parse_moment,
    strip,
)

__all__ = [
    "asc",
    "at_least_zero",
    "contains_text",
    "desc",
    "load_type_label",
    "moment",
    "moment_label",
    "number_starts_with",
    "order_status_label",
    "parse_decimal",
    "parse_moment",
    "ratio",
    "strip",
    "trailing_window",
    "within_dates",
    "without_excluded",
]
