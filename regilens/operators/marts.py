"""Dashboard data marts: overview KPIs, geography, category behaviour, the
star-schema wide table, seasonality, rankings and the missing-data KPI.

The report file itself carries no formulas, so these tables are defined from
the page descriptions on top of the analytic operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import any_like, null_flag, pct, rate, year_between
from regilens.operators.analytics import (
    DOG_KEY,
    GEO,
    KEY,
    discount_pred,
    late_pred,
    shared_flags,
    suburb_scorecard,
)
from regilens.operators.cleaning import dedup_keep_first
from regilens.operators.joins import key_flags, left_lookup


# FIXED VALUES: the discount incentives, by their transaction type pattern
INCENTIVES = {"Fenced": "%Fenced%", "Neutered": "%Neuter%", "Obedience": "%Obedience%", "Permanent_ID": "%Permanent%"}


# D01 -----------------------------------------------------------------------------
def overview_kpis(reg: DataFrame, txn: DataFrame | None, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                  key: str = KEY, flags: DataFrame | None = None) -> DataFrame:
    """One row: distinct registrations, how many had a late penalty / a
    discount, and both shares in percent."""
    keys = reg.select(key).filter(F.col(key).isNotNull()).distinct()
    kf = shared_flags(txn, flags, {"__late": ("late", late_pred()),
                                   "__disc": ("disc_a", discount_pred(patterns))}, key)
    j = keys.join(kf, key, "left")
    out = j.agg(F.count(F.col(key)).alias("Total_Registrations"),
                F.count(F.when(F.col("__late") == 1, F.col(key))).alias("Late_Registrations"),
                F.count(F.when(F.col("__disc") == 1, F.col(key))).alias("Discount_Registrations"))
    return out.select("*", pct(F.col("Late_Registrations"), F.col("Total_Registrations")).alias("Late_Pct"),
                      pct(F.col("Discount_Registrations"), F.col("Total_Registrations")).alias("Discount_Uptake_Pct"))


# D02 -----------------------------------------------------------------------------
def geo_mart(reg: DataFrame, dog: DataFrame, txn: DataFrame | None, geo: str = GEO,
             scorecard: DataFrame | None = None) -> DataFrame:
    """Suburb scorecard next to the suburb's dog population (both are
    suburb-level aggregates; the join is between two small tables)."""
    pop = dog.filter(F.col(geo).isNotNull()).groupBy(geo).agg(F.count(F.lit(1)).alias("Dog_Count"))
    sc = suburb_scorecard(reg, dog, txn, geo=geo) if scorecard is None else scorecard
    return (pop.join(sc, geo, "full")
               .select(geo, "Dog_Count", "Total_Registrations", "LatePayment_Count", "LatePayment_Rate",
                       "Discount_Count", "Discount_Rate")
               .orderBy(F.col("LatePayment_Rate").desc_nulls_last(), F.col(geo)))


# D03 -----------------------------------------------------------------------------
def category_behaviour(reg: DataFrame, txn: DataFrame | None, category: str = "Fee_Code_Description",
                       key: str = KEY, flags: DataFrame | None = None) -> DataFrame:
    """Per owner category: distinct registrations, defaulting ones (at least
    one late penalty), compliant ones (the rest), ones with a prompt payment,
    and the default rate."""
    base = reg.select(category, key).distinct()
    kf = shared_flags(txn, flags, {"__late": ("late", late_pred()),
                                   "__prompt": ("prompt", late_pred(value=K.PROMPT_PAYMENT))}, key)
    j = base.join(kf, key, "left")
    out = j.groupBy(category).agg(
        F.count(F.col(key)).alias("Registrations"),
        F.count(F.when(F.col("__late") == 1, F.col(key))).alias("Default_Registrations"),
        F.count(F.when(F.col("__prompt") == 1, F.col(key))).alias("Prompt_Registrations"))
    return (out.select(category, "Registrations", "Default_Registrations",
                       (F.col("Registrations") - F.col("Default_Registrations")).alias("Compliant_Registrations"),
                       "Prompt_Registrations",
                       rate(F.col("Default_Registrations"), F.col("Registrations")).alias("Default_Rate"))
               .orderBy(F.col("Default_Rate").desc_nulls_last(), F.col(category)))


# D04 -----------------------------------------------------------------------------
REG_ATTRS = ("Registration_From", "Registration_To", "Fee_Code_Description", "Calculated_Fee")
DOG_ATTRS = ("Kept_At_Suburb", "Fee_Description")


def star_wide(txn: DataFrame, reg: DataFrame, dog: DataFrame, key: str = KEY, dog_key: str = DOG_KEY,
              reg_attrs: Iterable[str] = REG_ATTRS, dog_attrs: Iterable[str] = DOG_ATTRS,
              keep_first: bool = False) -> DataFrame:
    """Wide table: every transaction left-joined to its registrations and
    those to their dogs. Keys that repeat fan out, as the plain joins do.

    ``keep_first`` resolves a repeated key to its lowest-FID row instead, for
    a table of exactly one row per transaction. Rows without a key are salted
    by their FID so they spread over the join's partitions instead of piling
    onto one; a hot key is split by the skew join."""
    if keep_first:
        reg = dedup_keep_first(reg.filter(F.col(key).isNotNull()), [key])
        dog = dedup_keep_first(dog.filter(F.col(dog_key).isNotNull()), [dog_key])
    facts = txn.select(F.col("FID").alias("Transaction_FID"), key, "Transaction_Date",
                       "Transaction_Value", "Transaction_Type")
    with_reg = left_lookup(facts, reg.select(key, dog_key, *reg_attrs), key, spread="Transaction_FID")
    return (left_lookup(with_reg, dog.select(dog_key, *dog_attrs), dog_key, spread="Transaction_FID")
                 .select("Transaction_FID", key, "Transaction_Date", "Transaction_Value", "Transaction_Type",
                         dog_key, *reg_attrs, *dog_attrs))


# D05 -----------------------------------------------------------------------------
def seasonality(reg: DataFrame, date_col: str = "Registration_From", first_year: int = K.SEASON_FIRST_YEAR,
                last_year: int = K.SEASON_LAST_YEAR) -> DataFrame:
    """Registrations per calendar month over the analysis years, with the
    peak month flagged. The peak is a window over the (at most 12) monthly
    rows, not over the data."""
    m = (reg.filter(year_between(date_col, first_year, last_year))
            .groupBy(F.month(date_col).alias("Month"))
            .agg(F.count(F.lit(1)).alias("Registration_Count")))
    peak = F.max("Registration_Count").over(Window.partitionBy(F.lit(1)))
    return m.select("Month", "Registration_Count", (F.col("Registration_Count") == peak).alias("Is_Peak")) \
            .orderBy("Month")


def late_seasonality(reg: DataFrame, txn: DataFrame, reg_date: str = "Registration_From",
                     txn_date: str = "Transaction_Date", first_year: int = K.SEASON_FIRST_YEAR,
                     last_year: int = K.SEASON_LAST_YEAR) -> DataFrame:
    """Registrations and late penalties per calendar month over the analysis
    years, each with its share of the year's total in percent, so the rise of
    penalties after the registration peak shows. Both sides are at most 12
    rows before they meet."""
    starts = (reg.filter(year_between(reg_date, first_year, last_year))
                 .groupBy(F.month(reg_date).alias("Month")).agg(F.count(F.lit(1)).alias("r")))
    lates = (txn.filter(late_pred() & year_between(txn_date, first_year, last_year))
                .groupBy(F.month(txn_date).alias("Month")).agg(F.count(F.lit(1)).alias("l")))
    both = starts.join(lates, "Month", "full").select(
        "Month", F.coalesce("r", F.lit(0)).alias("Registration_Count"), F.coalesce("l", F.lit(0)).alias("LatePenalty_Count"))
    year = Window.partitionBy(F.lit(1))  # at most 12 rows
    return both.select("*", pct(F.col("Registration_Count"), F.sum("Registration_Count").over(year)).alias("Registration_Pct"),
                       pct(F.col("LatePenalty_Count"), F.sum("LatePenalty_Count").over(year)).alias("LatePenalty_Pct")).orderBy("Month")


def incentive_uptake(reg: DataFrame, dog: DataFrame, txn: DataFrame, key: str = KEY, dog_key: str = DOG_KEY, geo: str = GEO,
                     incentives: dict[str, str] | None = None, rg: DataFrame | None = None) -> DataFrame:
    """Per suburb and incentive: distinct registrations, those with at least
    one transaction of the incentive, and the rate. One flag row per key from
    one scan of the transactions. ``rg`` may supply a precomputed
    :func:`~regilens.operators.analytics.registration_geo`; without it both
    sides are reduced to distinct pairs before they meet, so a dog number that
    repeats on both sides makes no row pairs."""
    incentives = INCENTIVES if incentives is None else incentives
    flags = key_flags(txn, key, {name: any_like("Transaction_Type", [p]) for name, p in incentives.items()})
    if rg is not None:  # distinct pairs already
        homes = rg.filter(F.col(geo).isNotNull()).select(key, geo)
    else:
        dims = dog.filter(F.col(geo).isNotNull() & F.col(dog_key).isNotNull()).select(dog_key, geo).distinct()
        homes = reg.select(key, dog_key).distinct().join(dims, dog_key).select(key, geo).distinct()
    per = homes.join(flags, key, "left").groupBy(geo).agg(
        F.count(key).alias("Registrations"), *[F.count_if(F.col(name) == 1).alias(name) for name in incentives])
    long = per.unpivot([geo, "Registrations"], list(incentives), "Incentive", "Incentive_Count")
    return long.select(geo, "Incentive", "Registrations", "Incentive_Count",
                       rate(F.col("Incentive_Count"), F.col("Registrations")).alias("Uptake_Rate")).orderBy(geo, "Incentive")


# D06 -----------------------------------------------------------------------------
def _ranked(df: DataFrame, label: str, value: Column, order: list[Column], geo: str, k: int) -> DataFrame:
    top = df.select(geo, value.cast("double").alias("Value")).orderBy(*order).limit(k)
    w = Window.partitionBy(F.lit(label)).orderBy(*order)
    return top.select(F.lit(label).alias("Ranking"), F.row_number().over(w).cast("int").alias("Rank"),
                      geo, "Value")


def suburb_rankings(reg: DataFrame, dog: DataFrame, txn: DataFrame | None, k: int = 5, geo: str = GEO,
                    scorecard: DataFrame | None = None) -> DataFrame:
    """Top-k and bottom-k suburbs by late-payment rate (scorecard) and top-k by
    dog population; ties broken by suburb name. ``limit`` after ``orderBy``
    plans as a per-partition top-k merged once (no global sort)."""
    sc = suburb_scorecard(reg, dog, txn, geo=geo) if scorecard is None else scorecard
    sc = sc.filter(F.col("LatePayment_Rate").isNotNull())
    pop = dog.filter(F.col(geo).isNotNull()).groupBy(geo).agg(F.count(F.lit(1)).alias("Dog_Count"))
    v = F.col("Value")
    parts = [
        _ranked(sc, "late_rate_top", F.col("LatePayment_Rate"), [v.desc(), F.col(geo).asc()], geo, k),
        _ranked(sc, "late_rate_bottom", F.col("LatePayment_Rate"), [v.asc(), F.col(geo).asc()], geo, k),
        _ranked(pop, "population_top", F.col("Dog_Count"), [v.desc(), F.col(geo).asc()], geo, k),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("Ranking", "Rank")


# D07 -----------------------------------------------------------------------------
def missing_share(reg: DataFrame, a: str = "Amount_Paid", b: str = "Effective_Date") -> DataFrame:
    """Share of registrations missing the payment, the effective date, or
    either (the "12-13 %" data-quality KPI)."""
    either = F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(1)).otherwise(F.lit(0))
    out = reg.agg(F.count(F.lit(1)).alias("Total_Registrations"),
                  F.sum(null_flag(a)).alias("Null_AmountPaid"),
                  F.sum(null_flag(b)).alias("Null_EffectiveDate"),
                  F.sum(either).alias("Null_Either"))
    t = F.col("Total_Registrations")
    return out.select("*", pct(F.col("Null_AmountPaid"), t).alias("AmountPaid_Missing_Pct"),
                      pct(F.col("Null_EffectiveDate"), t).alias("EffectiveDate_Missing_Pct"),
                      pct(F.col("Null_Either"), t).alias("Either_Missing_Pct"))
