"""The calendar cube: counts per date field, day and event class, built from one
scan of each fact, and the trend queries answered from it.

The cube holds one row per (date field, day, event classes): some thousands of
rows whatever the facts hold, so a refresh scans the facts once and every year,
month and season question after it reads the cube only. Days are calendar days:
for facts that carry times of day, ``historic_dates`` counts per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import null_flag, pct, year_at_least, year_below, year_between
from regilens.operators.analytics import discount_pred, late_pred

REGISTRATION_DATES = ("Registration_From", "Registration_To", "Effective_Date")
TRANSACTION_DATE = "Transaction_Date"
CLASSES = ("Is_Late", "Is_Prompt", "Is_Discount")


def calendar_cube(reg: DataFrame, txn: DataFrame) -> DataFrame:
    """``DateField, Event_Date, Is_Late, Is_Prompt, Is_Discount, Row_Count,
    Null_AmountPaid, Null_EffectiveDate``. The classes are false and the NULL
    counts of the registrations, NULL and 0 where they don't apply."""
    dates = F.explode(F.array(*[F.struct(F.lit(c).alias("DateField"), F.col(c).cast("date").alias("Event_Date")) for c in REGISTRATION_DATES]))
    starts = reg.select(dates.alias("d"), null_flag("Amount_Paid").alias("a"), null_flag("Effective_Date").alias("e")) \
        .select("d.*", *[F.lit(False).alias(c) for c in CLASSES], "a", "e")
    predicates = (late_pred(), late_pred(value=K.PROMPT_PAYMENT), discount_pred())
    events = txn.select(F.lit(TRANSACTION_DATE).alias("DateField"), F.col(TRANSACTION_DATE).cast("date").alias("Event_Date"),
                        *[F.coalesce(p, F.lit(False)).alias(c) for c, p in zip(CLASSES, predicates)], F.lit(0).alias("a"), F.lit(0).alias("e"))

    def counted(df: DataFrame) -> DataFrame:  # each fact is grouped by itself: days of one never meet the other's
        return df.groupBy("DateField", "Event_Date", *CLASSES).agg(
            F.count(F.lit(1)).alias("Row_Count"), F.sum("a").alias("Null_AmountPaid"), F.sum("e").alias("Null_EffectiveDate"))
    return counted(starts).unionByName(counted(events))


def _of(cube: DataFrame, field: str, event: str | None = None) -> DataFrame:
    rows = cube.filter(F.col("DateField") == field)
    return rows if event is None else rows.filter(F.col(event))


def year_distribution(cube: DataFrame, columns: Sequence[str]) -> DataFrame:
    year = F.year("Event_Date").alias("Yr")
    if len(columns) == 1:
        return _of(cube, columns[0]).groupBy(year).agg(F.sum("Row_Count").alias("Cnt")).orderBy("Yr")
    rows = cube.filter(F.col("DateField").isin(*columns))
    return rows.groupBy("DateField", year).agg(F.sum("Row_Count").alias("Cnt")).orderBy("DateField", "Yr")


def monthly_counts(cube: DataFrame, event: str | None, min_year: int | None, name: str) -> DataFrame:
    rows = _of(cube, TRANSACTION_DATE, event)
    if min_year is not None:
        rows = rows.filter(year_at_least("Event_Date", min_year))
    return rows.groupBy(F.year("Event_Date").alias("Year"), F.month("Event_Date").alias("Month")) \
        .agg(F.sum("Row_Count").alias(name)).orderBy("Year", "Month")


def historic_dates(cube: DataFrame, before_year: int = 2000, name: str = "Count_Records") -> DataFrame:
    rows = _of(cube, TRANSACTION_DATE).filter(year_below("Event_Date", before_year))
    return rows.groupBy(F.col("Event_Date").alias(TRANSACTION_DATE)).agg(F.sum("Row_Count").alias(name)) \
        .orderBy(F.col(name).desc(), F.col(TRANSACTION_DATE).asc())


def yearly_counts(cube: DataFrame, min_year: int = K.TREND_MIN_YEAR) -> DataFrame:
    return _of(cube, "Registration_From").filter(year_at_least("Event_Date", min_year)) \
        .groupBy(F.year("Event_Date").alias("Year")).agg(F.sum("Row_Count").alias("Registration_Count")).orderBy("Year")


def missing_by_year(cube: DataFrame, min_year: int = K.TREND_MIN_YEAR) -> DataFrame:
    return _of(cube, "Registration_From").filter(year_at_least("Event_Date", min_year)).groupBy(F.year("Event_Date").alias("Year")) \
        .agg(F.sum("Null_AmountPaid").alias("Null_AmountPaid"), F.sum("Null_EffectiveDate").alias("Null_EffectiveDate"),
             F.sum("Row_Count").alias("Total_Registrations")).orderBy("Year")


def monthly_activity(cube: DataFrame, min_year: int = K.TREND_MIN_YEAR) -> DataFrame:
    names = dict(zip(CLASSES, ("LatePayments", "PromptPayments", "Discounts")))
    rows = _of(cube, TRANSACTION_DATE).filter(year_at_least("Event_Date", min_year))
    return rows.groupBy(F.year("Event_Date").alias("Year"), F.month("Event_Date").alias("Month")) \
        .agg(*[F.sum(F.when(F.col(c), F.col("Row_Count")).otherwise(F.lit(0))).alias(n) for c, n in names.items()],
             F.sum("Row_Count").alias("TotalTransactions")).orderBy("Year", "Month")


def _months(cube: DataFrame, field: str, event: str | None, name: str, first_year: int, last_year: int) -> DataFrame:
    return _of(cube, field, event).filter(year_between("Event_Date", first_year, last_year)) \
        .groupBy(F.month("Event_Date").alias("Month")).agg(F.sum("Row_Count").alias(name))


def seasonality(cube: DataFrame, first_year: int = K.SEASON_FIRST_YEAR, last_year: int = K.SEASON_LAST_YEAR) -> DataFrame:
    months = _months(cube, "Registration_From", None, "Registration_Count", first_year, last_year)
    peak = F.max("Registration_Count").over(Window.partitionBy(F.lit(1)))  # at most 12 rows
    return months.select("Month", "Registration_Count", (F.col("Registration_Count") == peak).alias("Is_Peak")).orderBy("Month")


def late_seasonality(cube: DataFrame, first_year: int = K.SEASON_FIRST_YEAR, last_year: int = K.SEASON_LAST_YEAR) -> DataFrame:
    names = ("Registration_Count", "LatePenalty_Count")
    both = _months(cube, "Registration_From", None, names[0], first_year, last_year) \
        .join(_months(cube, TRANSACTION_DATE, "Is_Late", names[1], first_year, last_year), "Month", "full") \
        .select("Month", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    year = Window.partitionBy(F.lit(1))  # at most 12 rows
    shares = [pct(F.col(n), F.sum(n).over(year)).alias(n.replace("_Count", "_Pct")) for n in names]
    return both.select("*", *shares).orderBy("Month")


def late_lag(cube: DataFrame, first_year: int = K.SEASON_FIRST_YEAR, last_year: int = K.SEASON_LAST_YEAR) -> DataFrame:
    """Late penalties by their distance from the registration peak: for each
    calendar month its distance after the peak month (0 to 11, the first month
    of several equal peaks), its penalties and their share in percent."""
    both = late_seasonality(cube, first_year, last_year)
    year = Window.partitionBy(F.lit(1))  # at most 12 rows
    peak = F.max(F.struct(F.col("Registration_Count"), (-F.col("Month")).alias("m"))).over(year)
    return both.withColumn("__p", -peak["m"]) \
        .select(F.pmod(F.col("Month") - F.col("__p"), F.lit(12)).cast("int").alias("Months_After_Peak"), "Month", "LatePenalty_Count", "LatePenalty_Pct") \
        .orderBy("Months_After_Peak")
