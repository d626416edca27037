"""Edge semantics of the operators on small hand-made frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regilens.functions.expressions import try_decimal
from regilens.operators import analytics as A
from regilens.operators import cleaning as C
from regilens.operators import joins as J
from regilens.operators import marts as M
from regilens.operators import quality as Q

D = dt.date


def test_integer_average_truncates(spark):
    # counts per group 1 and 2 -> integer average 1, not 1.5
    dog = spark.createDataFrame([("a",), ("b",), ("b",)], "Kept_At_Suburb string")
    r = A.group_count_stats(dog).first()
    assert (r.Avg_Dogs_Per_Suburb, r.Min_Dogs, r.Max_Dogs, r.Median_Dogs) == (1, 1, 2, 1.5)


def test_group_stats_on_empty_input_are_null(spark):
    dog = spark.createDataFrame([], "Kept_At_Suburb string")
    r = A.group_count_stats(dog).first()
    assert all(v is None for v in r)


def test_sum_without_else_is_null_when_nothing_matches(spark):
    txn = spark.createDataFrame([(1, "Other")], "Registration_Key bigint, Transaction_Type string")
    r = A.key_presence(txn).first()
    assert r.NullRegID is None and r.HasRegID is None


def test_missing_summary_on_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    r = A.missing_summary(df, {"Null_A": "a", "Null_B": "b"}, "Total").first()
    assert (r.Null_A, r.Null_B, r.Total) == (None, None, 0)


def test_try_cast_text(spark):
    rows = [("12.50",), ("",), ("N/A",), ("$5",), ("1,000",), ("1e3",), (" 12.345 ",), ("-5.00",),
            ("99999999999",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.v for r in df.select(try_decimal("s").alias("v")).collect()]
    assert got == [Decimal("12.50"), None, None, None, None, None, Decimal("12.35"), Decimal("-5.00"), None, None]
    loose = [r.v for r in df.select(try_decimal("s", strict=False).alias("v")).collect()]
    assert loose[5] == Decimal("1000.00")


def test_prefix_replace_touches_only_prefixed_rows_but_replaces_all(spark):
    df = spark.createDataFrame([("RD 3 RD Lane",), ("Ford RD 2",), ("RD",), (None,)], "Kept_At_Suburb string")
    got = [r.Kept_At_Suburb for r in C.standardise_prefix(df).collect()]
    assert got == ["Rural Hamilton 3 Rural Hamilton Lane", "Ford RD 2", "RD", None]


def test_recode_is_exact_match(spark):
    df = spark.createDataFrame([("Probat. & Dangerous",), ("Probat. & Dangerous ",), ("DisabilityAssistDog",)],
                               "Fee_Code_Description string")
    got = [r[0] for r in C.recode_values(df).collect()]
    assert got == ["Probationary & Dangerous", "Probat. & Dangerous ", "Disability Assist Dog"]


def test_dedup_keeps_lowest_fid_and_groups_null_keys(spark):
    rows = [(5, None, "h"), (3, None, "h"), (9, 1, "h"), (2, 1, "h"), (4, 1, "x"), (None, 2, "h"), (1, 2, "h")]
    df = spark.createDataFrame(rows, "FID bigint, Registration_Key bigint, hash_binary string")
    got = {(r.Registration_Key, r.hash_binary): r.FID
           for r in C.dedup_keep_first(df, ["Registration_Key", "hash_binary"]).collect()}
    # a NULL FID sorts first, as ORDER BY does in the source database
    assert got == {(None, "h"): 3, (1, "h"): 2, (1, "x"): 4, (2, "h"): None}


def test_null_audit_one_pass(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a bigint, b string")
    got = {r.ColumnName: (r.Nulls, r.NullPct) for r in Q.null_audit(df, ["a", "b", "zz"]).collect()}
    assert got == {"a": (1, Decimal("33.33")), "b": (2, Decimal("66.67"))}
    with pytest.raises(ValueError):
        Q.null_audit(df, ["a", "zz"], strict=True)
    empty = Q.null_audit(spark.createDataFrame([], "a bigint"), ["a"]).first()
    assert (empty.Nulls, empty.NullPct) == (None, None)


def test_primary_key_check(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,), (3,), (3,)], "FID bigint")
    r = Q.assert_primary_key(df, "FID", "T").first()
    assert (r.Table_Name, r.Null_Count, r.Duplicate_Keys, r.Is_Valid) == ("T", 1, 2, False)
    with pytest.raises(ValueError):
        Q.check_primary_key(df, "FID", "T")
    Q.check_primary_key(spark.createDataFrame([(1,), (2,)], "FID bigint"))


def test_year_distribution_keeps_null_year(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), None), (None, D(2021, 5, 5))], "a date, b date")
    got = sorted((r.DateField, r.Yr or 0, r.Cnt) for r in Q.year_distribution(df, ["a", "b"]).collect())
    assert got == [("a", 0, 1), ("a", 2020, 1), ("b", 0, 1), ("b", 2021, 1)]


def test_date_outliers_pinned_as_of(spark):
    df = spark.createDataFrame([(D(1999, 12, 31), D(2001, 1, 1)), (D(2024, 1, 1), D(2023, 1, 1)),
                                (D(2026, 1, 1), D(2027, 1, 1)), (D(2010, 1, 1), D(2011, 1, 1))], "f date, t date")
    got = Q.date_outliers(df, "f", as_of=D(2025, 1, 1), end="t").count()
    assert got == 3


def _star(spark, dogs, regs, txns):
    dog = spark.createDataFrame(dogs, "FID bigint, Dog_Number bigint, Kept_At_Suburb string, Fee_Description string")
    reg = spark.createDataFrame(regs, "FID bigint, Registration_Key bigint, Dog_Number bigint, "
                                      "Fee_Code_Description string")
    txn = spark.createDataFrame(txns, "FID bigint, Registration_Key bigint, Transaction_Type string, "
                                      "Transaction_Date date")
    return dog, reg, txn


LATE = "Late Payment Penalty Fee"


def test_row_level_rate_equals_literal_fan_out(spark):
    # key 1 repeats in registrations, dog 10 repeats in the dimension (one copy
    # without suburb), key 1 has two late penalties: the literal join fans out
    dogs = [(1, 10, "A", "x"), (2, 10, None, "x"), (3, 11, "B", "y"), (4, 12, None, "y")]
    regs = [(1, 1, 10, "c"), (2, 1, 11, "c"), (3, 2, 11, "d"), (4, None, 10, "d"), (5, 3, 12, "d")]
    txns = [(1, 1, LATE, D(2021, 1, 1)), (2, 1, LATE, D(2021, 2, 1)), (3, 2, "Other", D(2021, 1, 1)),
            (4, 3, LATE, D(2021, 1, 1)), (5, None, LATE, D(2021, 1, 1))]
    dog, reg, txn = _star(spark, dogs, regs, txns)
    for t, n in ((dog, "dd"), (reg, "fr"), (txn, "ft")):
        t.createOrReplaceTempView(n)
    literal = spark.sql(f"""
        WITH L AS (SELECT fr.Registration_Key, 1 AS IsLate FROM ft JOIN fr ON ft.Registration_Key = fr.Registration_Key
                   JOIN dd ON fr.Dog_Number = dd.Dog_Number WHERE ft.Transaction_Type = '{LATE}'),
             R AS (SELECT fr.Registration_Key, dd.Kept_At_Suburb FROM fr JOIN dd ON fr.Dog_Number = dd.Dog_Number
                   WHERE dd.Kept_At_Suburb IS NOT NULL)
        SELECT r.Kept_At_Suburb, COUNT(l.IsLate) AS c, COUNT(*) AS t FROM R r LEFT JOIN L l
        ON r.Registration_Key = l.Registration_Key GROUP BY r.Kept_At_Suburb""")
    want = sorted((r[0], r[1], r[2]) for r in literal.collect())
    got = sorted((r.Kept_At_Suburb, r.LatePayment_Count, r.Total_Registrations)
                 for r in A.event_rate_by(reg, dog, txn, A.late_pred(), "LatePayment_Count",
                                          "LatePayment_Rate").collect())
    assert got == want


def test_scorecard_suburb_with_only_null_keys_has_null_rate(spark):
    dogs = [(1, 10, "A", "x"), (2, 11, "B", "x")]
    regs = [(1, 1, 10, "c"), (2, None, 11, "c")]
    txns = [(1, 1, LATE, D(2021, 1, 1))]
    dog, reg, txn = _star(spark, dogs, regs, txns)
    got = {r.Kept_At_Suburb: (r.Total_Registrations, r.LatePayment_Rate)
           for r in A.suburb_scorecard(reg, dog, txn).collect()}
    assert got == {"A": (1, 1.0), "B": (0, None)}


def test_events_after_first_are_strictly_later(spark):
    dogs = [(1, 10, "A", "x")]
    regs = [(1, 1, 10, "c")]
    d = "Neutered Discount"
    txns = [(1, 1, LATE, D(2021, 3, 1)), (2, 1, LATE, D(2021, 1, 1)), (3, 1, d, D(2021, 1, 1)),
            (4, 1, d, D(2021, 1, 2)), (5, 2, d, D(2022, 1, 1)), (6, None, d, D(2022, 1, 1))]
    _, _, txn = _star(spark, dogs, regs, txns)
    got = [(r.DiscountDate, r.LateDate) for r in A.events_after_first(txn, A.late_pred(), A.discount_pred()).collect()]
    assert got == [(D(2021, 1, 2), D(2021, 1, 1))]


def test_orphans_include_null_keys(spark):
    dogs = [(1, 10, "A", "x")]
    regs = [(1, 1, 10, "c")]
    d = "Neutered Discount"
    txns = [(1, 1, d, None), (2, 2, d, None), (3, None, d, None), (4, 2, "Fenced Property Discount", None)]
    _, reg, txn = _star(spark, dogs, regs, txns)
    got = sorted(tuple(r) for r in A.orphan_events(txn, reg).collect())
    assert got == [("Fenced Property Discount", 1), (d, 2)]


def test_pair_counts_equal_join_counts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a")], "k bigint, g string")
    right = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (None, "x")], "k bigint, h string")
    got = sorted(tuple(r) for r in J.pair_counts(left, right, "k", ["g"], ["h"]).collect())
    want = sorted(tuple(r) for r in left.join(right, "k").groupBy("g", "h").count().collect())
    assert got == want


def test_category_mismatches_match_literal_join(spark):
    dim = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (3, None)], "Dog_Number bigint, Fee_Description string")
    fact = spark.createDataFrame([(1, "B"), (1, "A"), (1, "C"), (2, "B"), (3, "A"), (None, "A")],
                                 "Dog_Number bigint, Fee_Code_Description string")
    got = sorted(tuple(r) for r in Q.category_mismatches(dim, fact).collect())
    assert got == [(1, "A", "B"), (1, "A", "B"), (1, "A", "C"), (1, "A", "C")]


def test_star_wide_joins_and_keep_first(spark):
    dogs = [(1, 10, "A", "x"), (2, 10, "B", "y")]
    regs = [(5, 1, 10, "c"), (3, 1, 10, "d")]
    txns = [(1, 1, LATE, None), (2, 1, "Other", None), (3, None, LATE, None), (4, 9, LATE, None)]
    dog, reg, txn = _star(spark, dogs, regs, txns)
    reg = (reg.withColumn("Registration_From", F.lit(None).cast("date"))
              .withColumn("Registration_To", F.lit(None).cast("date"))
              .withColumn("Calculated_Fee", F.lit(None).cast("decimal(10,2)")))
    txn = txn.withColumn("Transaction_Value", F.lit(None).cast("decimal(10,2)"))
    wide = M.star_wide(txn, reg, dog).collect()  # key 1: two transactions x two registrations x two dogs
    assert len(wide) == 2 * 2 * 2 + 2
    assert {(r.Fee_Code_Description, r.Kept_At_Suburb) for r in wide if r.Transaction_FID == 2} == {(c, s) for c in "cd" for s in "AB"}
    out = M.star_wide(txn, reg, dog, keep_first=True).collect()
    assert len(out) == 4
    by_fid = {r.Transaction_FID: r for r in out}
    assert by_fid[1].Fee_Code_Description == "d" and by_fid[1].Kept_At_Suburb == "A"
    assert by_fid[3].Dog_Number is None and by_fid[4].Dog_Number is None


def test_rankings_break_ties_by_name(spark):
    dogs = [(i, i, s, "x") for i, s in enumerate(["B", "A", "C", "C"])]
    regs = [(i, i, i, "c") for i in range(4)]
    txns = [(1, 0, LATE, None), (2, 1, LATE, None)]
    dog, reg, txn = _star(spark, dogs, regs, txns)
    rows = M.suburb_rankings(reg, dog, txn, k=2).collect()
    top = [(r.Rank, r.Kept_At_Suburb) for r in rows if r.Ranking == "late_rate_top"]
    assert top == [(1, "A"), (2, "B")]
    pop = [(r.Rank, r.Kept_At_Suburb, r.Value) for r in rows if r.Ranking == "population_top"]
    assert pop == [(1, "C", 2.0), (2, "A", 1.0)]


def test_seasonality_flags_peak(spark):
    regs = spark.createDataFrame([(D(2021, 7, 1),), (D(2022, 7, 3),), (D(2021, 1, 1),), (D(2019, 7, 1),),
                                  (D(2025, 7, 1),)], T.StructType([T.StructField("Registration_From", T.DateType())]))
    got = [(r.Month, r.Registration_Count, r.Is_Peak) for r in M.seasonality(regs).collect()]
    assert got == [(1, 1, False), (7, 2, True)]


@pytest.mark.parametrize("sizes,median", [([1, 1, 2, 5, 7], 2.0), ([1, 2, 3, 4], 2.5), ([3], 3.0),
                                          ([2, 2, 9, 9], 5.5)])
def test_exact_median_from_size_histogram(spark, sizes, median):
    rows = [(f"s{i}",) for i, n in enumerate(sizes) for _ in range(n)]
    dog = spark.createDataFrame(rows, "Kept_At_Suburb string")
    r = A.group_count_stats(dog).first()
    assert r.Median_Dogs == median
    assert r.Avg_Dogs_Per_Suburb == sum(sizes) // len(sizes)
    assert (r.Min_Dogs, r.Max_Dogs) == (min(sizes), max(sizes))


def test_optional_collation_matching(spark):
    df = spark.createDataFrame([("Late Payment Penalty Fee",), ("late payment penalty fee  ",),
                                ("NEUTERED discount",)], "Transaction_Type string")
    count = lambda p: df.filter(p).count()
    assert count(A.late_pred()) == 1
    assert count(A.late_pred(case_insensitive=True)) == 1
    assert count(A.late_pred(case_insensitive=True, ignore_trailing_spaces=True)) == 2
    assert count(A.discount_pred()) == 0
    assert count(A.discount_pred(case_insensitive=True)) == 1


def test_null_sorts_first_ascending_and_last_descending(spark):
    # source database order: NULL lowest
    df = spark.createDataFrame([(D(2021, 1, 1),), (None,), (D(2019, 1, 1),)], "Transaction_Date date")
    yrs = [r.Yr for r in Q.year_distribution(df, ["Transaction_Date"]).collect()]
    assert yrs == [None, 2019, 2021]
    dogs = [(1, 10, "A", "x"), (2, 11, "B", "x")]
    regs = [(1, 1, 10, "c"), (2, None, 11, "c")]
    txns = [(1, 1, LATE, None)]
    dog, reg, txn = _star(spark, dogs, regs, txns)
    rates = [r.LatePayment_Rate for r in A.suburb_scorecard(reg, dog, txn).collect()]
    assert rates == [1.0, None]


def test_every_discount_query_can_ignore_case(spark):
    from regilens.operators import analytics as A
    txn = spark.createDataFrame([(1, 1, "NEUTERED discount", -200.0, None), (2, 1, "NEUTERED discount", -200.0, None), (3, None, "Other", 1.0, None)],
                                "FID bigint, Registration_Key bigint, Transaction_Type string, Transaction_Value double, Transaction_Date date")
    txn = txn.withColumn("Transaction_Date", F.lit("2024-01-01").cast("date"))
    reg = spark.createDataFrame([(9,)], "Registration_Key bigint")
    for on in (False, True):
        assert A.matching_types(txn, case_insensitive=on).count() == int(on)
        assert A.key_presence(txn, case_insensitive=on).first().HasRegID == (2 if on else None)
        assert A.flag_events(txn, case_insensitive=on).where("IsDiscount = 1").count() == 2 * on
        assert A.count_by_type(txn, case_insensitive=on).count() == int(on)
        assert A.repeated_events(txn, case_insensitive=on).count() == int(on)
        assert A.discount_value_outliers(txn, case_insensitive=on).count() == 2 * on
        assert A.orphan_events(txn, reg, case_insensitive=on).count() == int(on)
        assert (A.event_date_range(txn, case_insensitive=on).first()[0] is not None) == on
