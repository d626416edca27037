"""Column-expression helpers. All built-in Spark SQL functions (JVM-side,
whole-stage codegen); no Python UDFs."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_like(c: ColumnOrName, patterns: Iterable[str], case_insensitive: bool = False) -> Column:
    """``c LIKE p1 OR c LIKE p2 ...``. Catalyst rewrites ``%x%`` to Contains and
    ``x%`` to StartsWith and pushes the OR to the Parquet reader.

    ``case_insensitive`` matches like a case-insensitive database collation
    (``ILIKE``); it is off by default (binary comparison)."""
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    cc = col(c)
    return reduce(lambda a, b: a | b, [cc.ilike(p) if case_insensitive else cc.like(p) for p in pats])


def equals_text(c: ColumnOrName, value: str, case_insensitive: bool = False,
                ignore_trailing_spaces: bool = False) -> Column:
    """``c = value``; optionally as a case-insensitive collation would compare
    and/or ignoring trailing spaces (as SQL ``=`` on padded text does). The
    default binary form is the one pushed into the Parquet scan."""
    left, right = col(c), value
    if ignore_trailing_spaces:
        left, right = F.rtrim(left), right.rstrip(" ")
    if case_insensitive:
        return F.lower(left) == F.lit(right.lower())
    return left == F.lit(right)


def starts_with(df: DataFrame, column: str, prefix: str) -> Column:
    """``column LIKE 'prefix%'``. A collation that ignores trailing blanks would
    drop them from the prefix too; the test then ignores case only."""
    trims = df.schema[column].dataType.simpleString().endswith("_RTRIM")
    return (F.collate(column, "UTF8_LCASE") if trims else F.col(column)).startswith(prefix)


def year_start(year: int) -> Column:
    """First day of ``year`` as a DATE literal.

    ``YEAR(d) >= y`` is not pushed to the scan by Catalyst; ``d >= DATE 'y-01-01'``
    is (and has the same NULL behaviour), so year filters are written as ranges."""
    return F.lit(_dt.date(year, 1, 1))


def year_at_least(date_col: ColumnOrName, year: int) -> Column:
    return col(date_col) >= year_start(year)


def year_below(date_col: ColumnOrName, year: int) -> Column:
    return col(date_col) < year_start(year)


def year_between(date_col: ColumnOrName, first: int, last: int) -> Column:
    return (col(date_col) >= year_start(first)) & (col(date_col) < year_start(last + 1))


def date_lit(value: str | _dt.date) -> Column:
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


def null_flag(c: ColumnOrName) -> Column:
    """1 when NULL else 0 (``SUM`` of it is NULL on an empty input, like SQL)."""
    return F.when(col(c).isNull(), F.lit(1)).otherwise(F.lit(0))


def pct(numerator: Column, denominator: Column, scale: str = "decimal(8,2)") -> Column:
    """``CAST(n * 100.0 / d AS DECIMAL(8,2))``; NULL (not an error) on d = 0."""
    return F.try_divide(numerator * F.lit(100.0), denominator).cast(scale)


def rate(numerator: Column, denominator: Column) -> Column:
    """``CAST(n AS FLOAT) / d`` as double; NULL (not an error) on d = 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


STRICT_DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def try_decimal(c: ColumnOrName, dtype: str = "decimal(10,2)", strict: bool = True) -> Column:
    """``TRY_CAST(text AS DECIMAL)``: bad text -> NULL.

    Spark also accepts exponent forms (``'1e3'``); ``strict=True`` keeps plain
    decimal text only, the stricter SQL rule."""
    cc = col(c)
    cast = cc.try_cast(dtype)
    if not strict:
        return cast
    return F.when(cc.rlike(STRICT_DECIMAL_TEXT), cast)


def replace_all(c: ColumnOrName, old: str, new: str) -> Column:
    """SQL ``REPLACE`` (every occurrence). ``F.replace`` reads plain strings as
    column names, so the search and replacement are wrapped in literals."""
    return F.replace(col(c), F.lit(old), F.lit(new))
