"""Named queries: one per statement of the source analysis, each bound to
the reference's parameters. A query maps a :class:`~regilens.plans.star.Star`
to a DataFrame; :func:`queries` binds them to ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regilens.functions import constants as K
from regilens.functions.expressions import try_decimal
from regilens.operators import analytics as A
from regilens.operators import audit as U
from regilens.operators import calendar as T
from regilens.operators import cleaning as C
from regilens.operators import dated as Y
from regilens.operators import marts as M
from regilens.operators import quality as Q
from regilens.operators import rescue as R
from regilens.plans.star import Star, fixture_star
from regilens.sources.staging import folded, plain

AS_OF = K.AS_OF

late = A.late_pred
disc = A.discount_pred


def _q(**kw):
    return kw


CATALOG: dict[str, Callable[[Star], DataFrame]] = _q(
    # --- 1. preparation ---------------------------------------------------------
    c01_build_dim_dog=lambda s: C.build_table(s.dog_stage),
    c02_build_fact_registration=lambda s: C.build_table(s.registration_stage),
    c03_build_fact_transaction=lambda s: C.build_fact_transaction(s.transaction_stage),
    # FIDs of the working copies are the staging FIDs (standardising never
    # touches them), so the checks read the written standardised tables
    c08_primary_key_dog=lambda s: Q.assert_primary_key(s.dog_std, "FID", "DimDog"),
    c08_primary_key_registration=lambda s: Q.assert_primary_key(s.registration_std, "FID", "FactRegistration"),
    c08_primary_key_transaction=lambda s: Q.assert_primary_key(s.transaction_std, "FID", "FactTransaction"),
    # --- 2. standardisation -----------------------------------------------------
    c04_standardise_suburb=lambda s: C.standardise_prefix(s.dog_stage),
    c05_recode_fee_labels=lambda s: C.recode_values(s.registration_stage),
    c06_registration_key=lambda s: s.registration_std,
    c06_transaction_key=lambda s: s.transaction_std,
    # --- 3. missing data ----------------------------------------------------------
    c07_null_audit_dog=lambda s: Q.null_audit(s.dog_std, K.DOG_AUDIT_COLUMNS),
    c07_null_audit_registration=lambda s: Q.null_audit(s.registration_std, K.REGISTRATION_AUDIT_COLUMNS),
    c07_null_audit_transaction=lambda s: Q.null_audit(s.transaction_std, K.TRANSACTION_AUDIT_COLUMNS),
    # --- 4. duplicate checks (before dedup) ----
    c09_null_fid_dog=lambda s: Q.null_key_count(s.dog_std, "FID", "NullCount_DimDog"),
    c10_duplicate_fid_dog=lambda s: Q.duplicate_keys(s.dog_std, ["FID"], "DuplicateCount_DimDog"),
    c09_null_fid_registration=lambda s: Q.null_key_count(s.registration_std, "FID", "NullCount_FactRegistration"),
    c10_duplicate_fid_registration=lambda s: Q.duplicate_keys(s.registration_std, ["FID"],
                                                              "DuplicateCount_FactRegistration"),
    c09_null_fid_transaction=lambda s: Q.null_key_count(s.transaction_std, "FID", "NullCount_FactTransaction"),
    c10_duplicate_fid_transaction=lambda s: Q.duplicate_keys(s.transaction_std, ["FID"],
                                                             "DuplicateCount_FactTransaction"),
    c11_dog_duplicate_hash=lambda s: Q.duplicate_keys(s.dog_std, ["Dog_Number", "hash_binary"]),
    c12_dog_duplicate_attrs=lambda s: Q.duplicate_keys(s.dog_std, K.DOG_DUPLICATE_ATTRS),
    c13_registration_duplicate_hash=lambda s: Q.duplicate_keys(s.registration_std,
                                                               [K.REGISTRATION_KEY, "hash_binary"]),
    c14_registration_duplicate_attrs=lambda s: Q.duplicate_keys(s.registration_std, K.REGISTRATION_DUPLICATE_ATTRS),
    c15_transaction_duplicate_hash=lambda s: Q.duplicate_keys(s.transaction_std,
                                                              [K.REGISTRATION_KEY, "hash_binary"]),
    c16_transaction_duplicate_attrs=lambda s: Q.duplicate_keys(s.transaction_std, K.TRANSACTION_DUPLICATE_ATTRS),
    # --- 5. dedup -------------------------------------------------------------------
    c17_dedup_dim_dog=lambda s: s.dog,
    c18_dedup_fact_registration=lambda s: s.registration,
    c19_dedup_fact_transaction=lambda s: s.transaction,
    # --- 6. structural validation -------------------------------------------------
    c20_date_order_violations=lambda s: Q.date_order_violations(s.registration),
    c21_flag_conflict_count=lambda s: Q.flag_conflict_count(s.registration),
    c22_category_crosstab=lambda s: Q.category_crosstab(s.dog, s.registration),
    c23_row_hash_dog=lambda s: C.row_hash(s.dog.drop("hash_binary")).select("FID", "Dog_Number", "Row_Hash"),
    c24_category_mismatches=lambda s: Q.category_mismatches(s.dog, s.registration),
    # --- 7. outliers ----------------------------------------------------------------
    c25_registration_date_outliers=lambda s: Q.date_outliers(s.registration, "Registration_From",
                                                             as_of=AS_OF, end="Registration_To"),
    c26_transaction_date_outliers=lambda s: Q.date_outliers(s.transaction, "Transaction_Date", as_of=AS_OF),
    c27_registration_year_distribution=lambda s: Q.year_distribution(
        s.registration, ["Registration_From", "Registration_To", "Effective_Date"]),
    c28_transaction_year_distribution=lambda s: Q.year_distribution(s.transaction, ["Transaction_Date"]),
    c29_amount_paid_outliers=lambda s: Q.numeric_outliers(s.registration, "Amount_Paid", parse_text=True),
    c30_calculated_fee_outliers=lambda s: Q.numeric_outliers(s.registration, "Calculated_Fee"),
    c31_transaction_value_outliers=lambda s: Q.numeric_outliers(s.transaction, "Transaction_Value"),
    c32_geo_anomalies=lambda s: Q.geo_anomalies(s.dog),
    c33_extreme_suburbs=lambda s: Q.extreme_groups(s.dog),
    # --- EDA: inspection --------------------------------------------------------------
    e01_inspect_dog=lambda s: A.inspect(s.dog, K.DOG_INSPECT_COLUMNS),
    e02_inspect_registration=lambda s: A.inspect(s.registration, K.REGISTRATION_INSPECT_COLUMNS),
    e03_inspect_transaction=lambda s: A.inspect(s.transaction, K.TRANSACTION_INSPECT_COLUMNS),
    # --- EDA 1: population --------------------------------------------------------------
    e04_total_dogs=lambda s: A.row_count(s.dog, "Total_Dogs"),
    e05_missing_geo=lambda s: A.missing_summary(
        s.dog, {"Null_Suburb": "Kept_At_Suburb", "Null_PostCode": "Kept_At_Post_Code",
                "Null_Town": "Kept_At_Town"}, "Total_Rows"),
    e06_dogs_by_suburb=lambda s: A.count_by(s.dog),
    e07_rare_suburbs=lambda s: A.rare_groups(s.dog),
    e08_suburb_count_stats=lambda s: A.group_count_stats(s.dog),
    # --- EDA 2: late payments ---------------------------------------------------------
    e09_late_payment_count=lambda s: A.event_count(s.transaction, late(), "LatePayment_Count"),
    e10_late_monthly_all=lambda s: A.monthly_counts(s.transaction, late(), None, "LatePayment_Count"),
    e11_historic_dates=lambda s: A.historic_dates(s.transaction),
    e13_late_by_category=lambda s: A.event_count_by_category(s.transaction, s.registration, late()),
    e14_late_by_suburb=lambda s: A.event_count_by_geo(s.transaction, s.registration, s.dog, late(), rg=s.geo_pairs),
    e12_late_rate_by_suburb=lambda s: A.event_rate_by(s.registration, s.dog, s.transaction, late(),
                                                      "LatePayment_Count", "LatePayment_Rate", rg=s.geo_pairs),
    # --- EDA 3: discounts -------------------------------------------------------------
    e15_discount_types=lambda s: A.matching_types(s.transaction),
    e16_discount_key_presence=lambda s: A.key_presence(s.transaction),
    e17_flag_discounts=lambda s: A.flag_events(s.transaction),
    e18_discount_counts_by_type=lambda s: A.count_by_type(s.transaction),
    e19_repeated_discounts=lambda s: A.repeated_events(s.transaction),
    e20_discounts_after_first_late=lambda s: A.events_after_first(s.transaction, late(), disc()),
    e21_discount_value_outliers=lambda s: A.discount_value_outliers(s.transaction),
    e22_orphan_discounts=lambda s: A.orphan_events(s.transaction, s.registration),
    e23_discount_rate_by_suburb=lambda s: A.event_rate_by(s.registration, s.dog, s.transaction, disc(),
                                                          "Discount_Count", "Discount_Rate", rg=s.geo_pairs),
    # --- EDA 4: lifecycle -------------------------------------------------------------
    e24_missing_payment_dates=lambda s: A.missing_summary(
        s.registration, {"Null_AmountPaid": "Amount_Paid", "Null_EffectiveDate": "Effective_Date"},
        "Total_Registrations"),
    e25_registrations_without_transactions=lambda s: A.unmatched(s.registration, s.transaction),
    # --- EDA 5: geography ---------------------------------------------------------------
    e06_suburb_population=lambda s: A.count_by(s.dog),
    e12_late_rate_by_suburb_geo=lambda s: A.event_rate_by(s.registration, s.dog, s.transaction, late(),
                                                          "LatePayment_Count", "LatePayment_Rate", rg=s.geo_pairs),
    e23_discount_rate_by_suburb_geo=lambda s: A.event_rate_by(s.registration, s.dog, s.transaction, disc(),
                                                              "Discount_Count", "Discount_Rate", rg=s.geo_pairs),
    e27_suburb_scorecard=lambda s: A.suburb_scorecard(s.registration, s.dog, s.transaction, rg=s.geo_pairs),
    # --- EDA 6: time series -------------------------------------------------------------
    e10_total_monthly=lambda s: A.monthly_counts(s.transaction, None, K.TREND_MIN_YEAR, "Transaction_Count"),
    e10_late_monthly=lambda s: A.monthly_counts(s.transaction, late(), K.TREND_MIN_YEAR, "LatePayment_Count"),
    e10_prompt_monthly=lambda s: A.monthly_counts(s.transaction, late(value=K.PROMPT_PAYMENT),
                                                  K.TREND_MIN_YEAR, "PromptPayment_Count"),
    e10_discount_monthly=lambda s: A.monthly_counts(s.transaction, disc(), K.TREND_MIN_YEAR, "Discount_Count"),
    e26_discount_date_range=lambda s: A.event_date_range(s.transaction),
    e28_yearly_registrations=lambda s: A.yearly_counts(s.registration),
    e29_missing_by_year=lambda s: A.missing_by_year(s.registration),
    e30_monthly_activity=lambda s: A.monthly_activity(s.transaction),
    # --- dashboard marts ------------------------------------------------------------------
    d01_overview_kpis=lambda s: M.overview_kpis(s.registration, s.transaction),
    d02_geo_mart=lambda s: M.geo_mart(s.registration, s.dog, s.transaction, scorecard=A.suburb_scorecard(
        s.registration, s.dog, s.transaction, rg=s.geo_pairs)),
    d03_category_behaviour=lambda s: M.category_behaviour(s.registration, s.transaction),
    d04_star_wide=lambda s: M.star_wide(s.transaction, s.registration, s.dog),
    d05_seasonality=lambda s: M.seasonality(s.registration),
    d02_incentive_uptake=lambda s: M.incentive_uptake(s.registration, s.dog, s.transaction, rg=s.geo_pairs),
    d05_late_seasonality=lambda s: M.late_seasonality(s.registration, s.transaction),
    d06_suburb_rankings=lambda s: M.suburb_rankings(s.registration, s.dog, s.transaction, scorecard=A.suburb_scorecard(
        s.registration, s.dog, s.transaction, rg=s.geo_pairs)),
    d07_missing_share=lambda s: M.missing_share(s.registration),
)


# --- all duplicate checks of a table from one shuffle -------------------------------
for _name, _table, _checks in (("dog", "dog_std", K.DOG_DUPLICATE_CHECKS), ("registration", "registration_std", K.REGISTRATION_DUPLICATE_CHECKS),
                               ("transaction", "transaction_std", K.TRANSACTION_DUPLICATE_CHECKS)):
    CATALOG[f"c10_duplicate_report_{_name}"] = lambda s, t=_table, c=_checks: Q.duplicate_report(getattr(s, t), c)

# --- audit figures counted by the jobs that wrote the tables ------------------------
for _name, _table in (("dog", "DimDog"), ("registration", "FactRegistration"), ("transaction", "FactTransaction")):
    CATALOG[f"c07_null_audit_{_name}_observed"] = lambda s, t=_table: U.null_audit(s.audit(f"{t}_std"))
    CATALOG[f"c09_null_fid_{_name}_observed"] = lambda s, t=_table: U.figure(s.audit(f"{t}_std"), U.NULLS, "FID", f"NullCount_{t}")
CATALOG.update(_q(
    c20_date_order_observed=lambda s: U.figure(s.audit("FactRegistration"), "date_order", "Registration_From", "Violation_Count"),
    c21_flag_conflict_count_observed=lambda s: U.figure(s.audit("FactRegistration"), "flag_conflict", "Effective_Date", "CountWithDate"),
    c25_registration_date_outliers_observed=lambda s: U.figure(s.audit("FactRegistration"), "date_outlier", "Registration_From", "Outlier_Count"),
    c26_transaction_date_outliers_observed=lambda s: U.figure(s.audit("FactTransaction"), "date_outlier", "Transaction_Date", "Outlier_Count"),
    # --- trends answered from the calendar cube ---------------------------------------
    c27_registration_year_distribution_cube=lambda s: T.year_distribution(s.calendar, T.REGISTRATION_DATES),
    c28_transaction_year_distribution_cube=lambda s: T.year_distribution(s.calendar, [T.TRANSACTION_DATE]),
    e10_late_monthly_all_cube=lambda s: T.monthly_counts(s.calendar, "Is_Late", None, "LatePayment_Count"),
    e10_total_monthly_cube=lambda s: T.monthly_counts(s.calendar, None, K.TREND_MIN_YEAR, "Transaction_Count"),
    e10_late_monthly_cube=lambda s: T.monthly_counts(s.calendar, "Is_Late", K.TREND_MIN_YEAR, "LatePayment_Count"),
    e10_prompt_monthly_cube=lambda s: T.monthly_counts(s.calendar, "Is_Prompt", K.TREND_MIN_YEAR, "PromptPayment_Count"),
    e10_discount_monthly_cube=lambda s: T.monthly_counts(s.calendar, "Is_Discount", K.TREND_MIN_YEAR, "Discount_Count"),
    e11_historic_dates_cube=lambda s: T.historic_dates(s.calendar),
    e28_yearly_registrations_cube=lambda s: T.yearly_counts(s.calendar),
    e29_missing_by_year_cube=lambda s: T.missing_by_year(s.calendar),
    e30_monthly_activity_cube=lambda s: T.monthly_activity(s.calendar),
    d05_seasonality_cube=lambda s: T.seasonality(s.calendar),
    d05_late_seasonality_cube=lambda s: T.late_seasonality(s.calendar),
    d05_late_lag=lambda s: T.late_lag(s.calendar),
))

# --- the facts laid out by date: only the years that a query can need are read ------
CATALOG.update(_q(
    c18_dedup_fact_registration_dated=lambda s: Y.whole(s.registration_dated),
    c19_dedup_fact_transaction_dated=lambda s: Y.whole(s.transaction_dated),
    c26_transaction_date_outliers_dated=lambda s: Q.date_outliers(Y.outside(s.transaction_dated, K.MIN_VALID_DATE, AS_OF), "Transaction_Date", as_of=AS_OF),
    e10_total_monthly_dated=lambda s: A.monthly_counts(Y.since_year(s.transaction_dated, K.TREND_MIN_YEAR), None, K.TREND_MIN_YEAR, "Transaction_Count"),
    e10_late_monthly_dated=lambda s: A.monthly_counts(Y.since_year(s.transaction_dated, K.TREND_MIN_YEAR), late(), K.TREND_MIN_YEAR, "LatePayment_Count"),
    e10_prompt_monthly_dated=lambda s: A.monthly_counts(Y.since_year(s.transaction_dated, K.TREND_MIN_YEAR), late(value=K.PROMPT_PAYMENT),
                                                        K.TREND_MIN_YEAR, "PromptPayment_Count"),
    e10_discount_monthly_dated=lambda s: A.monthly_counts(Y.since_year(s.transaction_dated, K.TREND_MIN_YEAR), disc(), K.TREND_MIN_YEAR, "Discount_Count"),
    e11_historic_dates_dated=lambda s: A.historic_dates(Y.before_year(s.transaction_dated, 2000)),
    # --- text that doesn't parse, kept beside the row ----------------------------------
    c29_rescued_amounts=lambda s: R.rescued_values(s.registration.withColumn(R.RESCUED, R.unparsed({"Amount_Paid": try_decimal("Amount_Paid")}))),
    c29_rescued_amount_texts=lambda s: R.rescued_counts(s.registration.withColumn(R.RESCUED, R.unparsed({"Amount_Paid": try_decimal("Amount_Paid")}))),
))

# --- labels that differ in case or trailing blanks are equal -------------------------
COLLATED: dict[str, Callable[[Star], DataFrame]] = _q(
    c04_standardise_suburb_collated=lambda s: plain(C.standardise_prefix(s.dog_stage)),
    c05_recode_fee_labels_collated=lambda s: plain(C.recode_values(s.registration_stage)),
    c32_geo_anomalies_collated=lambda s: folded(Q.geo_anomalies(s.dog)),
    c33_extreme_suburbs_collated=lambda s: folded(Q.extreme_groups(s.dog)),
    e06_dogs_by_suburb_collated=lambda s: folded(A.count_by(s.dog)),
    e07_rare_suburbs_collated=lambda s: folded(A.rare_groups(s.dog)),
    e12_late_rate_by_suburb_collated=lambda s: folded(A.event_rate_by(s.registration, s.dog, s.transaction, late(), "LatePayment_Count",
                                                                      "LatePayment_Rate", rg=s.geo_pairs)),
    e27_suburb_scorecard_collated=lambda s: folded(A.suburb_scorecard(s.registration, s.dog, s.transaction, rg=s.geo_pairs)),
)
CATALOG.update(COLLATED)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return CATALOG[name](fixture_star(spark, sf_dir, collated=name in COLLATED))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name):
        return lambda spark, sf_dir: run(spark, sf_dir, name)
    return {name: bind(name) for name in CATALOG}
