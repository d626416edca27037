"""Plan lint: what every catalogued plan must (not) contain."""

import contextlib
import io
import re

import pytest

from paths import SF_SMOKE
from regilens.plans import catalog
from regilens.plans.star import fixture_star

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.CATALOG))
def test_no_cross_join_nested_loop_or_python(spark, name):
    text = plan(catalog.run(spark, SF_SMOKE, name))
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"


def _fact_scans(text: str, table: str):
    """(PushedFilters, ReadSchema) of every scan of ``table`` in a formatted plan."""
    out = []
    for block in text.split("\n\n"):
        if "Scan parquet" in block and re.search(rf"/{table}\]", block):
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            schema = re.search(r"ReadSchema: struct<(.*)>", block)
            out.append((pushed.group(1) if pushed else "", schema.group(1) if schema else ""))
    return out


@pytest.mark.parametrize("name,must_push,max_cols", [
    ("e27_suburb_scorecard", ["StringContains(Transaction_Type,Fence)", "Late Payment Penalty Fee"], 2),
    ("e12_late_rate_by_suburb", ["EqualTo(Transaction_Type,Late Payment Penalty Fee)"], 2),
    ("e10_late_monthly", ["GreaterThanOrEqual(Transaction_Date,2020-01-01)"], 2),
    ("e11_historic_dates", ["LessThan(Transaction_Date,2000-01-01)"], 1),
    ("e30_monthly_activity", ["GreaterThanOrEqual(Transaction_Date,2020-01-01)"], 2),
    ("e25_registrations_without_transactions", ["IsNotNull(Registration_Key)"], 1),
])
def test_fact_scan_is_pruned_and_filtered(spark, name, must_push, max_cols):
    scans = _fact_scans(plan(catalog.run(spark, SF_SMOKE, name)), "FactTransaction")
    assert scans, f"{name}: no FactTransaction scan"
    for pushed, schema in scans:
        assert len(schema.split(",")) <= max_cols, schema
        for p in must_push:
            assert p in pushed, (p, pushed)


def test_dedup_limits_groups_before_the_shuffle(spark):
    lazy = fixture_star(spark, SF_SMOKE, materialised=False)
    text = plan(lazy.transaction, "simple")
    partial = text.index("WindowGroupLimit")
    lines = text.splitlines()
    # reading the tree top-down: Final limit, Exchange, then the Partial limit below it
    order = [ln.strip() for ln in lines if "WindowGroupLimit" in ln or "Exchange hashpartitioning" in ln]
    assert partial >= 0
    assert "Final" in order[0] and "Exchange" in order[1] and "Partial" in order[2], order


def test_scorecard_has_no_expand(spark):
    # distinct counts are planned as plain counts over distinct pairs
    assert "Expand" not in plan(catalog.run(spark, SF_SMOKE, "e27_suburb_scorecard"))


def test_clean_fact_files_are_date_ordered(spark):
    """Row-group statistics can only skip on a date filter when each file is
    ordered by that date."""
    import glob
    import os

    import pyarrow.parquet as pq

    star = fixture_star(spark, SF_SMOKE)
    for df, column in ((star.transaction, "Transaction_Date"), (star.registration, "Registration_From")):
        root = df.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "")
        files = glob.glob(os.path.join(root, "part-*.parquet"))
        assert files
        for f in files:
            values = [v for v in pq.read_table(f, columns=[column]).column(column).to_pylist() if v is not None]
            assert values == sorted(values), f


def _hot(spark, rows=120_000):
    """A third of the rows on one key."""
    return spark.range(rows).selectExpr("id as FID", "case when id % 3 = 0 then 1 else id end as k", "id % 5 as g")


def _run_plan(spark, df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skew_conf(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_of_events_after_first_is_split(spark, skew_conf):
    from pyspark.sql import functions as F

    from regilens.operators.analytics import events_after_first
    txn = _hot(spark).selectExpr("FID", "k as Registration_Key", "date_add(date'2020-01-01', cast(FID % 900 as int)) as Transaction_Date",
                                 "case when g = 0 then 'L' else 'D' end as Transaction_Type").repartition(8)
    out = events_after_first(txn, F.col("Transaction_Type") == "L", F.col("Transaction_Type") == "D")
    assert "skew=true" in _run_plan(spark, out)


def test_hot_key_of_category_mismatches_is_split(spark, skew_conf):
    from regilens.operators.quality import category_mismatches
    dim = spark.range(3000).selectExpr("id as Dog_Number", "'A' as Fee_Description")
    fact = _hot(spark).selectExpr("k as Dog_Number", "case when g = 0 then 'A' else md5(string(FID)) end as Fee_Code_Description").repartition(8)
    out = category_mismatches(dim, fact)
    assert "skew=true" in _run_plan(spark, out)
    assert out.count() == fact.join(dim, "Dog_Number").where("Fee_Code_Description <> 'A'").count()
