"""Facts laid out by date, refreshed year by year; text that doesn't parse."""

import datetime as dt
import glob
import os
import tempfile
from collections import Counter

import pytest

from paths import SF_SMOKE
from regilens.functions import constants as K
from regilens.operators import dated, rescue
from regilens.operators import quality as Q
from regilens.plans import build_star, catalog, materialise
from regilens.plans.yearly import read_years, refresh_years
from regilens.sources import load_stages, read_stage


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def star(spark):
    return materialise(spark, build_star(load_stages(spark, SF_SMOKE)), tempfile.mkdtemp(prefix="regilens-dated-"), "s", as_of=K.AS_OF)


def files_read(df) -> int:
    """Files the scan of an executed query opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    scans = plan.collectLeaves()
    total = 0
    for i in range(scans.size()):
        leaf = scans.apply(i)
        while not leaf.metrics().contains("numFiles"):
            leaf = leaf.plan() if "QueryStage" in leaf.getClass().getName() else leaf.child()
            below = leaf.collectLeaves()
            if below.size() and below.apply(0).metrics().contains("numFiles"):
                leaf = below.apply(0)
        total += leaf.metrics().apply("numFiles").value()
    return total


def test_date_filters_read_a_fraction_of_the_files(star):
    every = files_read(dated.whole(star.transaction_dated).select("FID"))
    assert every == len([f for f in star.transaction_dated.inputFiles()])
    for name in ("c26_transaction_date_outliers_dated", "e11_historic_dates_dated", "e10_total_monthly_dated"):
        few = files_read(catalog.CATALOG[name](star))
        assert 0 < few < every, (name, few, every)


def test_a_file_spans_few_days(spark, star):
    """Files of one year hold disjoint date ranges (but for the days at their ends)."""
    from pyspark.sql import functions as F
    spans = star.transaction_dated.groupBy(F.input_file_name().alias("f"), dated.YEAR).agg(F.min("Transaction_Date").alias("a"), F.max("Transaction_Date").alias("b"))
    by_year = {}
    for r in spans.where("a is not null").collect():
        by_year.setdefault(r[dated.YEAR], []).append((r["a"], r["b"]))
    for found in by_year.values():
        found.sort()
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("low", ["2000-01-01", "2000-06-15"])
def test_outside_keeps_every_outlier(spark, low):
    df = spark.createDataFrame([(i, dt.date(1998, 1, 1) + dt.timedelta(days=40 * i)) for i in range(300)] + [(900, None)], "FID long, d date")
    whole = Q.date_outliers(df, "d", low, "2025-01-01")
    assert rows(Q.date_outliers(dated.outside(df.selectExpr("*", f"year(d) as {dated.YEAR}"), low, "2025-01-01"), "d", low, "2025-01-01")) == rows(whole)


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{dated.YEAR}=*/*.parquet")}


def test_only_changed_years_are_rewritten(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="regilens-years-"), "fact")
    first = spark.range(400).selectExpr("id as FID", "if(id % 50 = 7, null, date_add(date'2018-01-01', cast(id * 5 as int))) as d", "cast(null as string) as a", "concat('x', id % 9) as b")
    assert refresh_years(spark, first, path, "d") == [2018, 2019, 2020, 2021, 2022, 2023, None]
    assert rows(dated.whole(read_years(spark, path))) == rows(first)
    before = stamps(path)
    assert refresh_years(spark, first.repartition(5), path, "d") == [] and stamps(path) == before
    # one year changes: a value moves from one column to another, so no count changes
    second = first.selectExpr("FID", "d", "if(year(d) = 2020, b, a) as a", "if(year(d) = 2020, null, b) as b")
    assert refresh_years(spark, second, path, "d") == [2020]
    after = stamps(path)
    same = {f for f in before if f"{dated.YEAR}=2020/" not in f}
    assert same and {f: after.get(f) for f in same} == {f: before[f] for f in same}
    assert not {f for f in before if f not in same} & set(after)
    assert rows(dated.whole(read_years(spark, path))) == rows(second)
    # a year and the rows without a date go, a new year comes
    third = second.where("year(d) <> 2019").union(spark.sql("select 999L, date'2031-02-03', 'p', 'q'"))
    assert refresh_years(spark, third, path, "d") == [2019, 2031, None]
    assert rows(dated.whole(read_years(spark, path))) == rows(third)


def test_a_broken_refresh_is_made_good(spark, monkeypatch):
    """A refresh that stops after the files changed; the next extract is the old one."""
    from regilens.plans import yearly
    path = os.path.join(tempfile.mkdtemp(prefix="regilens-years-"), "fact")
    old = spark.range(100).selectExpr("id as FID", "date_add(date'2020-01-01', cast(id * 9 as int)) as d", "'old' as a")
    refresh_years(spark, old, path, "d")
    store, calls = yearly._store, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        store(*args)
    monkeypatch.setattr(yearly, "_store", breaks)
    with pytest.raises(RuntimeError):
        refresh_years(spark, old.selectExpr("FID", "d", "if(year(d) = 2021, 'new', a) as a"), path, "d")
    monkeypatch.setattr(yearly, "_store", store)
    assert refresh_years(spark, old, path, "d") == [2021]
    assert rows(dated.whole(read_years(spark, path))) == rows(old)


def test_rescued_text(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="regilens-rescue-"), "txn")
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write('FID,Account_Number,Transaction_Date,Transaction_Value,Transaction_Type,Note\n1,7,2024-02-03,1.50,Late,a\n'
                '2,8,not a date,"x ""y""",Late,b\n3,,,,,c\nzz,9,2024-01-01,99999999999,Late,d\n')
    df = read_stage(spark, path, "Dog_Transaction_Stage", "csv", rescue=True, escape='"')
    got = rows(rescue.rescued_values(df))
    assert got == Counter({(2, "Transaction_Date", "not a date"): 1, (2, "Transaction_Value", 'x "y"'): 1, (None, "FID", "zz"): 1, (None, "Transaction_Value", "99999999999"): 1})
    plain = read_stage(spark, path, "Dog_Transaction_Stage", "csv", escape='"')
    assert rows(df.drop(rescue.RESCUED)) == rows(plain)  # the fingerprint doesn't change
    # the column survives a written table
    df.write.parquet(path + "-kept")
    kept = spark.read.parquet(path + "-kept")
    assert dict(kept.dtypes)[rescue.RESCUED] == "variant" and rows(rescue.rescued_values(kept)) == got
    assert rows(rescue.rescued_counts(kept))[("Transaction_Date", "not a date", 1)] == 1
    assert rescue.rescued_values(plain.withColumn(rescue.RESCUED, rescue.unparsed({}))).count() == 0
