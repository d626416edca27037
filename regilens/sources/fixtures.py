"""Derive the three staging tables from the TPC-H-like test tables.

dog <- customer JOIN nation, registration <- orders, transaction <- lineitem;
the foreign keys carry over (l_orderkey -> o_orderkey, o_custkey -> c_custkey).
Modulus rules inject the dirt the audit operators look for: NULLs, exact
duplicate rows, repeated keys, bad dates, orphans, dirty text and labels.

Every table is a narrow projection of one scan (plus, for dogs, a join to the
25-row nation table), so the derivation is map-only apart from that join. The
injected copies come from the same scan: each source row explodes into itself
plus the copies its key calls for (no second scan, no UNION).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regilens.session import hadoop_path, path_join
from regilens.sources.schemas import (
    DOG_STAGE,
    REGISTRATION_STAGE,
    TRANSACTION_STAGE,
    conform,
)

# FIXED VALUES: fixture label maps (source code -> staging label)
SEGMENT_FEE = {
    "AUTOMOBILE": "Standard",
    "BUILDING": "Selected Owner",
    "FURNITURE": "Working Dog",
    "HOUSEHOLD": "Disability Assist Dog",
}
SEGMENT_FEE_DEFAULT = "Probationary & Dangerous"
PRIORITY_FEE = {
    "1-URGENT": "Probat. & Dangerous",
    "2-HIGH": "DisabilityAssistDog",
    "3-MEDIUM": "Standard",
    "4-NOT SPECIFIED": "Selected Owner",
}
PRIORITY_FEE_DEFAULT = "Working Dog"
LINE_TYPES = {
    1: "Late Payment Penalty Fee",
    2: "Prompt Payment",
    3: "Fenced Property Discount",
    4: "Neutered Discount",
    5: "Obedience Training Discount",
    6: "Permanent Identification Discount",
}
LINE7_TYPE_A, LINE7_TYPE_B = "Fence Inspection Fee", "Registration Fee"

COPY_OFFSET = 100_000_000
REPEAT_OFFSET = 200_000_000
ORPHAN_OFFSET = 900_000_000
DEAL_BYTES = 8 << 20  # of a table's files per task


def _map(c: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def _years(d: Column, n: int) -> Column:
    return F.add_months(d, 12 * n)


def _date(s: str) -> Column:
    return F.to_date(F.lit(s))


def _with_copies(df: DataFrame, copies: dict[int, Column]) -> DataFrame:
    """Each row once as itself (``__v`` = 0) plus once per copy kind ``v``
    whose condition holds (``__v`` = v)."""
    variants = F.array(F.lit(0), *[F.when(cond, F.lit(v)) for v, cond in copies.items()])
    return df.withColumn("__v", F.explode(F.array_compact(variants)))


def _dirty_fid(df: DataFrame, by: str) -> DataFrame:
    """NULL and repeated FIDs for the key checks, by a business key (so a row
    and its exact copy get the same FID)."""
    k = F.col(by)
    return df.withColumn("FID", F.when(k % 70 == 3, F.lit(None).cast("bigint")).when(k % 90 == 4, F.lit(1).cast("bigint"))
                         .otherwise(F.col("FID"))).drop("__v")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dog_stage(customer: DataFrame, nation: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = nation.select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "inner")
    k = F.col("c_custkey")
    suburb = (F.when(k % 13 == 0, F.lit(None).cast("string"))
              .when(k % 17 == 0, F.concat(F.lit("RD "), ((F.col("c_nationkey") % 3) + 1).cast("string")))
              .when(k.isin(7, 14, 22), F.lit("Tiny Suburb"))
              .otherwise(F.col("n_name")))
    base = j.select(
        k.alias("FID"),
        k.alias("Dog_Number"),
        suburb.alias("Kept_At_Suburb"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise((F.lit(3200) + F.col("c_nationkey")).cast("string")).alias("Kept_At_Post_Code"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.lit("Hamilton")).alias("Kept_At_Town"),
        F.date_add(_date("2010-01-01"), (k % 3650).cast("int")).alias("Date_Of_Birth"),
        F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("Animal_Sex"),
        F.concat(F.lit("Breed "), (k % 20).cast("string")).alias("Primary_Breed"),
        F.concat(F.lit("Colour "), (k % 9).cast("string")).alias("Primary_Colour"),
        F.when(k % 5 == 0, F.lit("N")).otherwise(F.lit("Y")).alias("Active_Dog_Record"),
        _map(F.col("c_mktsegment"), SEGMENT_FEE, SEGMENT_FEE_DEFAULT).alias("Fee_Description"),
    )
    base = base.withColumn("hash_binary", F.md5(F.concat_ws(
        "|", F.col("Dog_Number").cast("string"), F.coalesce("Kept_At_Suburb", F.lit("~")),
        F.col("Primary_Breed"), F.col("Fee_Description"))))
    out = _with_copies(base, {1: F.col("Dog_Number") % 40 == 0})
    out = out.withColumn("FID", F.col("FID") + F.col("__v") * COPY_OFFSET)
    return conform(_dirty_fid(out, "Dog_Number"), DOG_STAGE)


def registration_stage(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    amount = (F.when(k % 8 == 0, F.lit(None).cast("string"))
              .when(k % 89 == 0, F.lit("N/A"))
              .when(k % 503 == 1, F.lit("-5.00"))
              .when(k % 401 == 1, F.lit("650.50"))
              .otherwise(F.concat((F.lit(50) + k % 150).cast("string"), F.lit(".00"))))
    base = o.select(
        k.alias("FID"),
        F.when(k % 1009 == 5, F.lit(None).cast("bigint")).otherwise(k).alias("Registration_ID"),
        F.when(k % 1013 == 7, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("Dog_Number"),
        F.when(k % 211 == 0, d).when(k % 307 == 0, _date("2099-07-01"))
         .otherwise(_years(d, 23)).alias("Registration_From"),
        F.when(k % 97 == 0, _date("1994-06-30")).when(k % 307 == 0, _date("2100-06-30"))
         .otherwise(_years(d, 24)).alias("Registration_To"),
        F.when(F.col("o_orderstatus") == "P", F.lit("N")).otherwise(F.lit("Y")).alias("Effective_Flag"),
        F.when(k % 8 == 0, F.lit(None).cast("date")).otherwise(_years(d, 23)).alias("Effective_Date"),
        F.when(k % 503 == 0, F.lit(-10)).when(k % 401 == 0, F.lit(650))
         .otherwise(F.lit(50) + k % 150).cast("decimal(10,2)").alias("Calculated_Fee"),
        F.col("o_orderpriority").alias("Fee_Code"),
        _map(F.col("o_orderpriority"), PRIORITY_FEE, PRIORITY_FEE_DEFAULT).alias("Fee_Code_Description"),
        amount.alias("Amount_Paid"),
    )
    base = base.withColumn("hash_binary", F.md5(F.concat_ws(
        "|", F.col("FID").cast("string"), F.col("Dog_Number").cast("string"), F.col("Fee_Code"),
        F.coalesce("Amount_Paid", F.lit("~")))))
    rid = F.col("Registration_ID")
    # 1: exact copy (same hash); 2: repeated key with a different hash
    out = _with_copies(base, {1: rid % 50 == 0, 2: rid % 60 == 1})
    v = F.col("__v")
    out = (out.withColumn("FID", F.col("FID") + F.when(v == 1, F.lit(COPY_OFFSET))
                          .when(v == 2, F.lit(REPEAT_OFFSET)).otherwise(F.lit(0)))
              .withColumn("hash_binary", F.when(v == 2, F.md5(F.concat(F.col("hash_binary"), F.lit("v2"))))
                          .otherwise(F.col("hash_binary"))))
    return conform(_dirty_fid(out, "Registration_ID"), REGISTRATION_STAGE)


def transaction_stage(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    d = F.col("l_shipdate").cast("date")
    ttype = _map(ln, LINE_TYPES, None)
    ttype = (F.when(ln == 7, F.when(pk % 3 == 0, F.lit(LINE7_TYPE_A)).otherwise(F.lit(LINE7_TYPE_B)))
             .otherwise(ttype))
    base = li.select(
        (((ok * 8 + ln) * 100000 + pk) * 10000 + sk).alias("FID"),
        F.when(pk % 101 == 0, F.lit(None).cast("bigint")).when(pk % 103 == 0, ok + ORPHAN_OFFSET)
         .otherwise(ok).alias("Account_Number"),
        F.when(sk % 10 == 0, F.lit("Animal Impounding")).otherwise(F.lit("Animal Registration"))
         .alias("Type_Of_Account"),
        F.when(pk % 151 == 0, d).when(pk % 157 == 0, _date("2099-01-01"))
         .otherwise(_years(d, 23)).alias("Transaction_Date"),
        F.when(pk % 173 == 0, F.lit(750))
         .when(ln.between(3, 6), F.when(pk % 29 == 0, F.lit(-150)).otherwise(F.lit(-20)))
         .otherwise(F.lit(60)).cast("decimal(10,2)").alias("Transaction_Value"),
        ttype.alias("Transaction_Type"),
    )
    base = base.withColumn("hash_binary", F.md5(F.concat_ws(
        "|", F.col("FID").cast("string"), F.col("Transaction_Type"))))
    out = _with_copies(base, {1: F.coalesce(F.col("Account_Number"), F.lit(0)) % 70 == 0})
    out = out.withColumn("FID", F.when(F.col("__v") == 1, -F.col("FID") - 1).otherwise(F.col("FID")))
    return conform(_dirty_fid(out, "Account_Number"), TRANSACTION_STAGE)


def _dealt(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a test table, dealt to all cores or, if that makes more, to
    tasks of :data:`DEAL_BYTES` of its files, so a task's rows fit in memory
    whatever the size. Many rows are dealt by the hash of their place in the
    scan: Spark sorts rows before it deals them in turn, and spills what doesn't
    fit."""
    fs, path = hadoop_path(spark, path_join(sf_dir, f"{name}.parquet"))
    rows, cores = read_table(spark, sf_dir, name).select(*columns), spark.sparkContext.defaultParallelism
    parts = -(-fs.getContentSummary(path).getLength() // DEAL_BYTES)
    return rows.repartition(parts, F.monotonically_increasing_id()) if parts > cores else rows.repartition(cores)


def load_stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three staging tables (lazy) derived from ``sf_dir``."""
    # the derivation (hashing, copies, casts) is the expensive part; each test
    # table is one file, so its rows are dealt first
    customer = _dealt(spark, sf_dir, "customer", ("c_custkey", "c_nationkey", "c_mktsegment"))
    nation = read_table(spark, sf_dir, "nation")
    orders = _dealt(spark, sf_dir, "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    lineitem = _dealt(spark, sf_dir, "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))
    return {
        "Dog_Stage": dog_stage(customer, nation),
        "Dog_Registration_Stage": registration_stage(orders),
        "Dog_Transaction_Stage": transaction_stage(lineitem),
    }


def loose_spelling(stages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The staging tables with labels in mixed case and with trailing blanks, by
    the row's business key."""
    def loose(label: str, key: str) -> Column:
        c, k = F.col(label), F.col(key)
        return F.when(k % 4 == 1, F.upper(c)).when(k % 4 == 2, F.lower(c)).when(k % 4 == 3, F.concat(c, F.lit("  "))).otherwise(c)
    return {**stages, "Dog_Stage": stages["Dog_Stage"].withColumn("Kept_At_Suburb", loose("Kept_At_Suburb", "Dog_Number")),
            "Dog_Registration_Stage": stages["Dog_Registration_Stage"].withColumn("Fee_Code_Description", loose("Fee_Code_Description", "Registration_ID"))}
