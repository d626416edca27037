"""Audit figures taken by the job that writes a table.

The figures of the quality checks that need no grouping (NULL counts, date
order, flag conflicts, date outliers) are observed metrics: Spark counts them
while the rows pass on to the files, so the audit costs no scan of its own. The
observed frame is the last step before the files; its tasks count once each.

An audit table has one row per figure: ``Metric, Field, Value``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import date_lit, pct

SCHEMA = "Metric string, Field string, Value bigint"
NULLS, ROWS = "nulls", "rows"

AUDITED = {
    "DimDog_std": ("FID", *K.DOG_AUDIT_COLUMNS),
    "FactRegistration_std": ("FID", *K.REGISTRATION_AUDIT_COLUMNS),
    "FactTransaction_std": ("FID", *K.TRANSACTION_AUDIT_COLUMNS),
}


def _outside(column: str, as_of: _dt.date, low: str = K.MIN_VALID_DATE) -> Column:
    return (F.col(column) < date_lit(low)) | (F.col(column) > date_lit(as_of))


def figures(table: str, as_of: _dt.date) -> dict[tuple[str, str], Column]:
    """(metric, field) -> the rows to count, for a written table's name."""
    if table in AUDITED:
        return {(ROWS, ""): F.lit(True), **{(NULLS, c): F.col(c).isNull() for c in AUDITED[table]}}
    if table == "FactRegistration":
        late = F.col("Registration_From") > F.col("Registration_To")
        return {(ROWS, ""): F.lit(True), ("date_order", "Registration_From"): late,
                ("flag_conflict", "Effective_Date"): (F.col("Effective_Flag") == "N") & F.col("Effective_Date").isNotNull(),
                ("date_outlier", "Registration_From"): _outside("Registration_From", as_of) | late}
    if table == "FactTransaction":
        return {(ROWS, ""): F.lit(True), ("date_outlier", "Transaction_Date"): _outside("Transaction_Date", as_of)}
    return {}


def observed(df: DataFrame, wanted: dict[tuple[str, str], Column]) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, c in enumerate(wanted.values())]), seen


def audit_rows(spark: SparkSession, wanted: dict[tuple[str, str], Column], values: dict[str, int]) -> DataFrame:
    """The audit table of the observed values (one row per figure)."""
    return spark.createDataFrame([(m, f, int(values.get(f"f{i}") or 0)) for i, (m, f) in enumerate(wanted)], SCHEMA).coalesce(1)


def scanned(df: DataFrame, wanted: dict[tuple[str, str], Column]) -> DataFrame:
    """The same figures by a scan, for a table that was written without."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, c in enumerate(wanted.values())])
    rows = F.array(*[F.struct(F.lit(m).alias("Metric"), F.lit(f).alias("Field"), F.col(f"f{i}").alias("Value")) for i, (m, f) in enumerate(wanted)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# the quality checks, read from an audit table -------------------------------------
def null_audit(audit: DataFrame) -> DataFrame:
    """C07: ``ColumnName, Nulls, NullPct``; NULL counts of an empty table are NULL."""
    total = F.max(F.when(F.col("Metric") == ROWS, F.col("Value"))).over(Window.partitionBy(F.lit(1)))  # one row per figure
    nulls = audit.withColumn("__n", total).filter((F.col("Metric") == NULLS) & (F.col("Field") != "FID"))
    return nulls.select(F.col("Field").alias("ColumnName"), F.when(F.col("__n") > 0, F.col("Value")).alias("Nulls"), pct(F.col("Value"), F.col("__n")).alias("NullPct"))


def figure(audit: DataFrame, metric: str, field: str, name: str) -> DataFrame:
    """One audited count as a table of one row."""
    return audit.filter((F.col("Metric") == metric) & (F.col("Field") == field)).agg(F.coalesce(F.sum("Value"), F.lit(0).cast("bigint")).alias(name))
