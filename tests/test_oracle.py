"""Every catalogued query against its DuckDB statement at sf0.01 (the
driver's correctness scale): row count, column names and types, values."""

import pytest

import __spark_entry__ as E
from paths import SF_ORACLE
from oracle_harness import compare, duck, order_problems
from regilens.plans import catalog

# sort columns ("-" descending) of the queries whose statement has an ORDER BY
ORDERED = {
    "c22_category_crosstab": ["Fee_Description", "Fee_Code_Description"], "c27_registration_year_distribution": ["DateField", "Yr"],
    "c28_transaction_year_distribution": ["Yr"], "c30_calculated_fee_outliers": ["Calculated_Fee"], "c31_transaction_value_outliers": ["Transaction_Value"],
    "c32_geo_anomalies": ["CountSuburb"], "e06_dogs_by_suburb": ["-Dog_Count"], "e06_suburb_population": ["-Dog_Count"], "e07_rare_suburbs": ["Dog_Count"],
    "e10_late_monthly_all": ["Year", "Month"], "e10_total_monthly": ["Year", "Month"], "e10_late_monthly": ["Year", "Month"],
    "e10_prompt_monthly": ["Year", "Month"], "e10_discount_monthly": ["Year", "Month"], "e11_historic_dates": ["-Count_Records"],
    "e12_late_rate_by_suburb": ["-LatePayment_Rate"], "e13_late_by_category": ["-LatePayment_Count"], "e14_late_by_suburb": ["-LatePayment_Count"],
    "e17_flag_discounts": ["-IsDiscount"], "e18_discount_counts_by_type": ["-Discount_Count"], "e19_repeated_discounts": ["-Duplicate_Count"],
    "e20_discounts_after_first_late": ["DiscountDate"], "e21_discount_value_outliers": ["Transaction_Value"], "e23_discount_rate_by_suburb": ["-Discount_Rate"],
    "e27_suburb_scorecard": ["-LatePayment_Rate"], "e28_yearly_registrations": ["Year"], "e29_missing_by_year": ["Year"], "e30_monthly_activity": ["Year", "Month"],
    "d05_seasonality": ["Month"], "d05_late_seasonality": ["Month"], "d06_suburb_rankings": ["Ranking", "Rank"],
}
ORDERED |= {n: ORDERED[n.rsplit("_", 1)[0]] for n in catalog.CATALOG if n.endswith(("_cube", "_collated", "_dated")) and n.rsplit("_", 1)[0] in ORDERED}
ORDERED["d05_late_lag"] = ["Months_After_Peak"]
NAMES = sorted(catalog.CATALOG)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.queries()) and set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_ORACLE)
    assert compare(df, con, E.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", NAMES)
def test_oracle_has_rows(con, name):
    assert con.sql(E.oracle_sql()[name]).limit(1).fetchall(), name


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_ordered_queries_are_in_order(spark, con, name):
    """Rows in the statement's order: its sort columns are compared in sequence."""
    assert order_problems(E.queries()[name](spark, SF_ORACLE), ORDERED[name]) == []
