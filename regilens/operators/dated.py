"""Facts laid out by date: one folder per year, date ranges inside.

Rows are range-partitioned by date (ties by the row id, so a day that holds a
third of all rows is split) and sorted by it. A file then spans a few days, a
year's files are in its own folder, and a date filter names the years it
needs, so the scan doesn't open the others. Rows without a date have a folder
of their own. The year column is named ``Part_Year`` and isn't a column of the
fact."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = "Part_Year"


def by_date(df: DataFrame, date_col: str, spread: str = "FID") -> DataFrame:
    """``df`` with its year, in the layout to be written by :data:`YEAR`."""
    order = [date_col, *([spread] if spread in df.columns else [])]
    return df.withColumn(YEAR, F.year(date_col)).repartitionByRange(*order).sortWithinPartitions(YEAR, *order)


def whole(dated: DataFrame) -> DataFrame:
    return dated.drop(YEAR)


def since_year(dated: DataFrame, year: int) -> DataFrame:
    return dated.filter(F.col(YEAR) >= year).drop(YEAR)


def before_year(dated: DataFrame, year: int) -> DataFrame:
    return dated.filter(F.col(YEAR) < year).drop(YEAR)


def outside(dated: DataFrame, low: str | _dt.date, high: str | _dt.date) -> DataFrame:
    """The years that can hold a date before ``low`` or after ``high``."""
    at = lambda d: _dt.date.fromisoformat(d) if isinstance(d, str) else d
    first = at(low).year - (1 if (at(low).month, at(low).day) == (1, 1) else 0)
    return dated.filter((F.col(YEAR) <= first) | (F.col(YEAR) >= at(high).year)).drop(YEAR)
