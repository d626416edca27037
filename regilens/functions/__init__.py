"""Column expressions and fixed domain values."""

from regilens.functions import constants
from regilens.functions.expressions import (
    any_like,
    date_lit,
    equals_text,
    null_flag,
    pct,
    rate,
    replace_all,
    try_decimal,
    year_at_least,
    year_below,
    year_between,
    year_start,
)

__all__ = [
    "constants", "any_like", "date_lit", "equals_text", "null_flag",
    "pct", "rate", "replace_all", "try_decimal", "year_at_least", "year_below",
    "year_between", "year_start",
]
