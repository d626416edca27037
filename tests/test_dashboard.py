"""The one-scan dashboard refresh writes the same tables as the standalone
queries."""

import tempfile
from collections import Counter

from paths import SF_SMOKE
from regilens.plans import catalog
from regilens.plans.dashboard import refresh_dashboard
from regilens.plans.star import fixture_star

SAME_AS = {
    "suburb_scorecard": "e27_suburb_scorecard",
    "overview_kpis": "d01_overview_kpis",
    "geo_mart": "d02_geo_mart",
    "category_behaviour": "d03_category_behaviour",
    "star_wide": "d04_star_wide",
    "seasonality": "d05_seasonality",
    "late_seasonality": "d05_late_seasonality",
    "incentive_uptake": "d02_incentive_uptake",
    "suburb_rankings": "d06_suburb_rankings",
    "missing_share": "d07_missing_share",
    "monthly_activity": "e30_monthly_activity",
}


def test_refresh_equals_standalone_queries(spark):
    out = refresh_dashboard(spark, fixture_star(spark, SF_SMOKE), tempfile.mkdtemp(prefix="regilens-dash-"))
    for table, query in SAME_AS.items():
        want = catalog.run(spark, SF_SMOKE, query)
        got = out[table]
        assert got.columns == want.columns, table
        assert Counter(got.collect()) == Counter(want.collect()), table
