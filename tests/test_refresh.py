"""Audits counted while writing, duplicate checks in one shuffle, the calendar
cube, and labels compared without regard to case and trailing blanks."""

import contextlib
import datetime as dt
import io
import os
import re
import tempfile
from collections import Counter

from paths import SF_SMOKE
from regilens.functions import constants as K
from regilens.operators import audit, calendar, marts
from regilens.operators import cleaning as C
from regilens.operators import quality as Q
from regilens.plans import build_star, catalog, materialise
from regilens.sources import load_stages
from regilens.sources.staging import collate_stage, folded, plain, read_stages


def text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def fresh(spark, **more):
    root = tempfile.mkdtemp(prefix="regilens-refresh-")
    return materialise(spark, build_star(load_stages(spark, SF_SMOKE)), root, "s", **more), os.path.join(root, "s")


def test_audit_is_counted_by_the_writing_job(spark):
    star, folder = fresh(spark, as_of=K.AS_OF)
    assert star.registration.count() > 0
    written = f"FactRegistration_audit_{K.AS_OF}"
    assert written in os.listdir(folder)  # without asking for it
    seen = {(r["Metric"], r["Field"]): r["Value"] for r in star.audit("FactRegistration").collect()}
    assert seen["rows", ""] == star.registration.count()
    assert seen["date_order", "Registration_From"] == Q.date_order_violations(star.registration).count()
    assert seen["flag_conflict", "Effective_Date"] == Q.flag_conflict_count(star.registration).first()[0]
    assert seen["date_outlier", "Registration_From"] == Q.date_outliers(star.registration, "Registration_From", as_of=K.AS_OF, end="Registration_To").count()
    assert "FactRegistration/" not in text(star.audit("FactRegistration"))
    # another run date has no figures yet: one scan, then stored
    other = materialise(spark, build_star(load_stages(spark, SF_SMOKE)), os.path.dirname(folder), "s", as_of=dt.date(1990, 1, 1))
    want = Q.date_outliers(star.transaction, "Transaction_Date", as_of="1990-01-01").count()
    assert other.audit("FactTransaction").where("Metric = 'date_outlier'").first()["Value"] == want


def test_audit_of_an_empty_table(spark):
    wanted = audit.figures("FactTransaction", K.AS_OF)
    empty = spark.createDataFrame([], "Transaction_Date date")
    df, seen = audit.observed(empty, wanted)
    df.write.format("noop").mode("overwrite").save()
    assert rows(audit.audit_rows(spark, wanted, seen.get)) == rows(audit.scanned(empty, wanted))


def test_all_duplicate_checks_share_one_exchange(spark):
    star, _ = fresh(spark)
    for table, checks in ((star.dog_std, K.DOG_DUPLICATE_CHECKS), (star.registration_std, K.REGISTRATION_DUPLICATE_CHECKS), (star.transaction_std, K.TRANSACTION_DUPLICATE_CHECKS)):
        report = Q.duplicate_report(table, checks)
        tree = text(report).split("\n\n")[0]
        assert len(re.findall(r"\bExchange\b", tree)) == 1 and tree.count("Scan") == 1
        for check, columns in checks.items():
            assert rows(Q.duplicates_of(report, checks, check)) == rows(Q.duplicate_keys(table, list(columns)))


def test_cube_is_written_from_one_scan_of_each_fact(spark):
    star, _ = fresh(spark)
    build = text(calendar.calendar_cube(star.registration, star.transaction)).split("\n\n")[0]
    assert build.count("Scan parquet") == 2
    for name in [n for n in catalog.CATALOG if n.endswith("_cube")]:
        plan = text(catalog.CATALOG[name](star))
        assert "CalendarCube" in plan and "/FactTransaction" not in plan and "/FactRegistration" not in plan, name


def test_incentive_uptake_makes_no_row_pairs(spark):
    """A dog number that a third of both tables share."""
    n = 3000
    reg = spark.range(n).selectExpr("id % 900 as Registration_Key", "if(id % 3 = 0, 1, id) as Dog_Number")
    dog = spark.range(n).selectExpr("if(id % 3 = 0, 1, id) as Dog_Number", "concat('S', id % 2) as Kept_At_Suburb")
    txn = spark.range(n).selectExpr("id % 1000 as Registration_Key", "if(id % 5 = 0, 'Neutered Discount', 'Fenced Property Discount') as Transaction_Type")
    got = marts.incentive_uptake(reg, dog, txn)
    for view, df in (("r", reg), ("d", dog), ("t", txn)):
        df.createOrReplaceTempView(view)
    pairs = "(select distinct Registration_Key k, Kept_At_Suburb s from r join (select distinct * from d) using (Dog_Number))"
    want = spark.sql(f"""select s, i, count(*) n, count_if(k in (select Registration_Key from t where Transaction_Type like concat('%', i, '%'))) m
                         from {pairs}, (values ('Fenced'), ('Neuter')) v(i) group by s, i""")
    names = {"Fenced": "Fenced", "Neutered": "Neuter"}
    assert {(r[0], names[r["Incentive"]], r["Registrations"], r["Incentive_Count"]) for r in got.collect() if r["Incentive"] in names} == {tuple(r) for r in want.collect()}
    star, _ = fresh(spark)
    assert "/DimDog" not in text(catalog.CATALOG["d02_incentive_uptake"](star))  # the stored pairs


def test_collated_labels(spark):
    rows_ = [(1, "RD 2"), (2, "rd 2  "), (3, "RDX"), (4, "rd"), (5, "Hill "), (6, "HILL"), (7, None), (8, "rural hamilton 2")]
    dog = collate_stage(spark.createDataFrame(rows_, "Dog_Number long, Kept_At_Suburb string").selectExpr("*", "'a' as Kept_At_Town", "'b' as Fee_Description", "'H' as hash_binary"), "Dog_Stage")
    fixed = C.standardise_prefix(dog)
    assert {r[0]: r["Kept_At_Suburb"] for r in plain(fixed).collect()} == {1: "Rural Hamilton 2", 2: "Rural Hamilton 2  ", 3: "RDX", 4: "rd", 5: "Hill ", 6: "HILL", 7: None, 8: "rural hamilton 2"}
    got = {r[0]: r[1] for r in folded(Q.extreme_groups(fixed)).collect()}
    assert got == {"rural hamilton 2": 3, "rdx": 1, "rd": 1, "hill": 2, None: 1}
    assert {r[0]: r[1] for r in folded(Q.geo_anomalies(fixed)).collect()} == {"rural hamilton 2": 3, None: 1}
    assert dict(fixed.dtypes)["hash_binary"] == "string"


def test_readers_collate_on_demand(spark):
    folder = tempfile.mkdtemp(prefix="regilens-collate-")
    stages = load_stages(spark, SF_SMOKE)
    stages["Dog_Stage"].write.parquet(f"{folder}/dog")
    (dog,) = read_stages(spark, {"Dog_Stage": f"{folder}/dog"}, collated=True).values()
    assert dict(dog.dtypes)["Kept_At_Suburb"] == "string collate UTF8_LCASE_RTRIM"
    (same,) = read_stages(spark, {"Dog_Stage": f"{folder}/dog"}).values()
    assert dict(same.dtypes)["Kept_At_Suburb"] == "string"
    star = materialise(spark, build_star(stages, collated=True), folder, "s")
    star.dog.count()
    late = star.transaction.where("Transaction_Type = 'late payment penalty fee'")  # case only
    assert late.count() == star.transaction.where("Transaction_Type like '%LATE PAYMENT%'").count() > 0
