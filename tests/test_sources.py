"""Staging readers: Parquet and CSV extracts come back with the explicit
staging schemas, and the fixture adapter yields the documented row counts."""

import os
import tempfile
from collections import Counter

import pytest

from paths import SF_ORACLE
from regilens.sources import STAGE_SCHEMAS, load_stages, read_stage


@pytest.fixture(scope="module")
def stages(spark):
    return load_stages(spark, SF_ORACLE)


def test_fixture_row_counts(stages):
    # FIXTURES.md section 4, before dedup (the transaction count is after the account filter)
    assert stages["Dog_Stage"].count() == 1538
    assert stages["Dog_Registration_Stage"].count() == 15549
    txn = stages["Dog_Transaction_Stage"]
    assert txn.filter("Type_Of_Account = 'Animal Registration'").count() == 55253


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip_with_explicit_schema(spark, stages, fmt):
    root = tempfile.mkdtemp(prefix="regilens-src-")
    for table, df in stages.items():
        path = os.path.join(root, table)
        if fmt == "csv":
            df.write.option("header", "true").csv(path)
        else:
            df.write.parquet(path)
        back = read_stage(spark, path, table, fmt)
        assert back.schema.simpleString() == STAGE_SCHEMAS[table].simpleString()
        assert Counter(back.collect()) == Counter(df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_missing_row_fingerprint_is_computed(spark, stages, fmt):
    root = tempfile.mkdtemp(prefix="regilens-nohash-")
    df = stages["Dog_Stage"].drop("hash_binary")
    path = os.path.join(root, "dog")
    (df.write.option("header", "true").csv(path) if fmt == "csv" else df.write.parquet(path))
    back = read_stage(spark, path, "Dog_Stage", fmt)
    assert back.columns == STAGE_SCHEMAS["Dog_Stage"].fieldNames()
    hashes = [r.hash_binary for r in back.collect()]
    assert all(h and len(h) == 64 for h in hashes)
    # rows equal except FID share a fingerprint (the injected copies do)
    assert len(set(hashes)) == df.drop("FID").distinct().count()


def _write(path, text):
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write(text)


def test_extra_columns_and_times_are_kept(spark, stages):
    path = os.path.join(tempfile.mkdtemp(prefix="regilens-extra-"), "txn")
    df = stages["Dog_Transaction_Stage"].limit(5).selectExpr(
        "Transaction_Type", "'web' as Channel", "cast(Transaction_Date as timestamp) + interval 9 hours as Transaction_Date", "FID", "Account_Number",
        "Type_Of_Account", "Transaction_Value", "hash_binary")
    df.write.parquet(path)
    back = read_stage(spark, path, "Dog_Transaction_Stage")
    assert back.columns == [*STAGE_SCHEMAS["Dog_Transaction_Stage"].fieldNames(), "Channel"]
    assert dict(back.dtypes)["Transaction_Date"] == "timestamp"
    assert all(r.Channel == "web" and r.Transaction_Date.hour == 9 for r in back.collect())


def test_csv_columns_go_by_header_name(spark):
    from regilens.sources.staging import parse_failures
    path = os.path.join(tempfile.mkdtemp(prefix="regilens-csv-"), "txn")
    _write(path, "Account_Number,FID,Note,Transaction_Date,Transaction_Value,Transaction_Type\n"
                 "1,777,a,2024-02-03 10:11:12,1.50,Prompt Payment\n2,778,b,not a date,x,Late\n,779,c,,,\n")
    rows = {r.FID: r for r in read_stage(spark, path, "Dog_Transaction_Stage", "csv").collect()}
    assert (rows[777].Account_Number, str(rows[777].Transaction_Date), str(rows[777].Transaction_Value), rows[777].Note) == (1, "2024-02-03", "1.50", "a")
    assert rows[777].Type_Of_Account is None and rows[778].Transaction_Date is None and rows[779].Account_Number is None
    timed = read_stage(spark, path, "Dog_Transaction_Stage", "csv", date_times=True).where("FID = 777").first()
    assert timed.Transaction_Date.hour == 10
    bad = parse_failures(spark, path, "Dog_Transaction_Stage").first().asDict()
    assert bad == {"FID": 0, "Account_Number": 0, "Transaction_Date": 1, "Transaction_Value": 1}


def test_rows_are_dealt_by_the_size_of_the_files(spark, tmp_path, monkeypatch):
    """More files, more tasks: a task's rows don't grow with the input. No row
    is lost or made, and none is sorted for it."""
    from pyspark.sql import functions as F

    from regilens.sources import fixtures
    for t, columns in (("customer", "id as c_custkey, 1L as c_nationkey, 'BUILDING' as c_mktsegment"), ("nation", "1L as n_nationkey, 'X' as n_name"),
                       ("orders", "id as o_orderkey, id as o_custkey, 'P' as o_orderstatus, date'1995-01-01' as o_orderdate, '2-HIGH' as o_orderpriority"),
                       ("lineitem", "id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, date'1995-01-01' as l_shipdate")):
        spark.range(1 if t == "nation" else 20000).selectExpr(*columns.split(", ")).repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    monkeypatch.setattr(fixtures, "DEAL_BYTES", size // 60, raising=False)
    dealt = load_stages(spark, str(tmp_path))["Dog_Transaction_Stage"]
    per_task = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) >= 60 and max(per_task) < 1000
    assert Counter(r[0] for r in dealt.select("hash_binary").collect()) == Counter(
        r[0] for r in fixtures.transaction_stage(spark.read.parquet(str(tmp_path / "lineitem.parquet"))).select("hash_binary").collect())
    assert "Sort" not in dealt._jdf.queryExecution().executedPlan().toString() and "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_written_tables_shuffle_by_the_size_of_their_input(spark, tmp_path, monkeypatch):
    """A session of few shuffle partitions: the rows of a task don't grow with
    the input, and the session keeps its number."""
    from regilens.operators.dated import YEAR, by_date
    from regilens.plans import star
    spark.range(20000).selectExpr("id as FID", "date_add(date'2020-01-01', cast(id % 300 as int)) as d", "uuid() as u").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    monkeypatch.setattr(star, "SHUFFLE_BYTES", size // 40, raising=False)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = star.write_table(spark, by_date(df, "d"), str(tmp_path / "out"), partition_by=(YEAR,))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "out").rglob("*.parquet"))) >= 40
    assert Counter(got.drop(YEAR).collect()) == Counter(df.collect())


def test_written_tables_are_compressed_densely(spark, tmp_path):
    """The hashes are most of a fact's bytes: as hexadecimal text they take half
    the room with an entropy coder."""
    import pyarrow.parquet as pq

    from regilens.operators.dated import YEAR, by_date
    from regilens.plans import star
    df = spark.range(5000).selectExpr("id as FID", "date_add(date'2020-01-01', cast(id % 700 as int)) as d", "md5(cast(id as string)) as hash_binary")
    got = star.write_table(spark, df, str(tmp_path / "plain"))
    dated = star.write_table(spark, by_date(got, "d"), str(tmp_path / "dated"), partition_by=(YEAR,))
    files = [f for folder in ("plain", "dated") for f in (tmp_path / folder).rglob("*.parquet")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(2).compression for f in files} == {"ZSTD"}
    assert sum(f.stat().st_size for f in (tmp_path / "plain").glob("*.parquet")) < 5000 * 26
    assert Counter(dated.drop(YEAR).collect()) == Counter(df.collect())
