"""Data-quality audit: NULL profile, key checks, duplicate detection,
structural validation and outliers.

Every check is a single scan + (at most) one keyed aggregation with map-side
partial aggregation; multi-column profiles are one aggregate, not one scan
per column."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import date_lit, null_flag, pct, starts_with, try_decimal
from regilens.operators.joins import pair_counts


# C07 -----------------------------------------------------------------------------
def null_audit(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """``ColumnName, Nulls, NullPct`` for the requested columns that exist.

    One aggregate computes every column's NULL count and the row count in a
    single pass; ``unpivot`` turns the one wide row into one row per column.
    Unknown names are skipped (``strict=True`` raises instead)."""
    present = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not in table: {missing}")
    if not present:
        raise ValueError("no audited column exists in the table")
    total = "__total"
    wide = df.agg(*[F.sum(null_flag(c)).cast("bigint").alias(c) for c in present],
                  F.count(F.lit(1)).alias(total))
    long = wide.unpivot([total], present, "ColumnName", "Nulls")
    return long.select("ColumnName", "Nulls", pct(F.col("Nulls"), F.col(total)).alias("NullPct"))


# C08 -----------------------------------------------------------------------------
def assert_primary_key(df: DataFrame, key: str = "FID", table: str = "table") -> DataFrame:
    """One row: ``Table_Name, Null_Count, Duplicate_Keys, Is_Valid``.

    The declarative primary-key constraint becomes a check: one aggregation
    per key value, then a global aggregate over it."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    out = per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("__c"))), F.lit(0).cast("bigint")).alias("Null_Count"),
        F.count(F.when(F.col(key).isNotNull() & (F.col("__c") > 1), F.lit(1))).alias("Duplicate_Keys"),
    )
    return out.select(F.lit(table).alias("Table_Name"), "Null_Count", "Duplicate_Keys",
                      ((F.col("Null_Count") == 0) & (F.col("Duplicate_Keys") == 0)).alias("Is_Valid"))


def check_primary_key(df: DataFrame, key: str = "FID", table: str = "table") -> None:
    """Raise when ``key`` has NULLs or repeats (an action returning one row)."""
    row = assert_primary_key(df, key, table).first()
    if not row["Is_Valid"]:
        raise ValueError(f"{table}.{key}: {row['Null_Count']} NULL, {row['Duplicate_Keys']} repeated keys")


# C09 -----------------------------------------------------------------------------
def null_key_count(df: DataFrame, key: str = "FID", name: str = "NullCount") -> DataFrame:
    return df.filter(F.col(key).isNull()).agg(F.count(F.lit(1)).alias(name))


# C10 - C16 -----------------------------------------------------------------------
def duplicate_keys(df: DataFrame, columns: Sequence[str], name: str = "DuplicateCount") -> DataFrame:
    """Groups of ``columns`` with more than one row (NULLs group together)."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
              .filter(F.col(name) > 1))


def duplicate_report(df: DataFrame, checks: Mapping[str, Sequence[str]], name: str = "DuplicateCount") -> DataFrame:
    """All duplicate checks of a table from one shuffle: ``Check_Name``, the
    columns of all checks (NULL where a check doesn't use one) and the count.

    Every row is tagged with each check and grouped once by the check and its
    columns (grouping sets), with partial aggregation on the map side; a NULL
    key is told from an unused column by the grouping id."""
    columns = list(dict.fromkeys(c for cols in checks.values() for c in cols))
    top = len(columns) - 1
    ids = {check: sum(1 << (top - i) for i, c in enumerate(columns) if c not in cols) for check, cols in checks.items()}
    if len(set(ids.values())) < len(ids):
        raise ValueError("two checks use the same columns")
    grouped = df.groupingSets([[F.col(c) for c in cols] for cols in checks.values()], *columns) \
        .agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
    label = F.element_at(F.create_map(*[x for check, g in ids.items() for x in (F.lit(g).cast("bigint"), F.lit(check))]), F.col("__g"))
    return grouped.select(label.alias("Check_Name"), *columns, name)


def duplicates_of(report: DataFrame, checks: Mapping[str, Sequence[str]], check: str, name: str = "DuplicateCount") -> DataFrame:
    """One check's groups out of a :func:`duplicate_report`."""
    return report.filter(F.col("Check_Name") == check).select(*checks[check], F.col("DuplicateCount").alias(name))


# C20 -----------------------------------------------------------------------------
def date_order_violations(df: DataFrame, start: str = "Registration_From", end: str = "Registration_To",
                          keep: Sequence[str] = (K.REGISTRATION_KEY, "Registration_From", "Registration_To")
                          ) -> DataFrame:
    return df.filter(F.col(start) > F.col(end)).select(*keep)


# C21 -----------------------------------------------------------------------------
def flag_conflict_count(df: DataFrame, flag: str = "Effective_Flag", value: str = "N",
                        column: str = "Effective_Date", name: str = "CountWithDate") -> DataFrame:
    return (df.filter((F.col(flag) == F.lit(value)) & F.col(column).isNotNull())
              .agg(F.count(F.lit(1)).alias(name)))


# C22 -----------------------------------------------------------------------------
def category_crosstab(dim: DataFrame, fact: DataFrame, key: str = "Dog_Number",
                      a: str = "Fee_Description", b: str = "Fee_Code_Description",
                      name: str = "RecordCount") -> DataFrame:
    """Joined rows per (dimension category, fact category), counted from
    per-key category counts of each side (no row pairs are produced)."""
    return pair_counts(dim, fact, key, [a], [b], name=name).orderBy(a, b)


# C24 -----------------------------------------------------------------------------
def category_mismatches(dim: DataFrame, fact: DataFrame, key: str = "Dog_Number",
                        a: str = "Fee_Description", b: str = "Fee_Code_Description",
                        names: tuple[str, str] = ("DimDog_Fee", "Fact_Fee")) -> DataFrame:
    """Every joined (dimension row, fact row) whose categories differ (a NULL
    on either side is not a difference).

    The result *is* the row pairs, so this is the plain equi-join with the
    difference as its residual condition: neither side is aggregated first,
    and the skew join splits a hot key's rows over many tasks."""
    left = dim.select(key, F.col(a).alias(names[0]))
    right = fact.select(F.col(key).alias("__key"), F.col(b).alias(names[1]))
    return left.join(right, (F.col(key) == F.col("__key")) & (F.col(names[0]) != F.col(names[1]))).drop("__key")


# C25 / C26 -----------------------------------------------------------------------
def date_outliers(df: DataFrame, column: str, low: str | _dt.date = K.MIN_VALID_DATE,
                  as_of: str | _dt.date | None = None, end: str | None = None) -> DataFrame:
    """Rows dated before ``low``, after ``as_of`` (default: today), or whose
    ``end`` precedes the start. ``as_of`` pins the run date for reproducible
    output."""
    c = F.col(column)
    top = F.current_date() if as_of is None else date_lit(as_of)
    cond = (c < date_lit(low)) | (c > top)
    if end is not None:
        cond = cond | (F.col(end) < c)
    return df.filter(cond)


# C27 / C28 -----------------------------------------------------------------------
def year_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per calendar year of each date column (NULL year kept).

    One column: ``Yr, Cnt``. Several: ``DateField, Yr, Cnt`` from one scan
    (the columns are unpivoted and grouped once instead of one scan each)."""
    if len(columns) == 1:
        c = columns[0]
        return (df.groupBy(F.year(c).alias("Yr")).agg(F.count(F.lit(1)).alias("Cnt"))
                  .orderBy("Yr"))
    long = df.select(*columns).unpivot([], list(columns), "DateField", "__d")
    return (long.groupBy("DateField", F.year("__d").alias("Yr"))
                .agg(F.count(F.lit(1)).alias("Cnt"))
                .orderBy("DateField", "Yr"))


# C29 - C31 -----------------------------------------------------------------------
def numeric_outliers(df: DataFrame, column: str, low: float = K.VALUE_LOW, high: float = K.VALUE_HIGH,
                     parse_text: bool = False, order_tiebreak: str | None = "FID") -> DataFrame:
    """Rows whose value is below ``low`` or above ``high``, ordered by value.

    ``parse_text`` reads a free-text column with TRY_CAST semantics (bad text
    is NULL and falls out of both tests). The tie-break column lets the range
    partitioning behind the sort split runs of equal values."""
    v: Column = try_decimal(column) if parse_text else F.col(column)
    out = df.filter((v < low) | (v > high))
    order = [v] + ([F.col(order_tiebreak)] if order_tiebreak and order_tiebreak in df.columns else [])
    return out.orderBy(*order)


# C32 -----------------------------------------------------------------------------
def geo_anomalies(df: DataFrame, column: str = "Kept_At_Suburb", prefix: str = K.RURAL_PREFIX,
                  name: str = "CountSuburb") -> DataFrame:
    c = F.col(column)
    return (df.filter(starts_with(df, column, prefix) | c.isNull())
              .groupBy(column).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.col(name), F.col(column)))


# C33 -----------------------------------------------------------------------------
def extreme_groups(df: DataFrame, column: str = "Kept_At_Suburb", low: int = K.EXTREME_GROUP_LOW,
                   high: int = K.EXTREME_GROUP_HIGH, name: str = "DogCount") -> DataFrame:
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
              .filter((F.col(name) > high) | (F.col(name) < low)))
