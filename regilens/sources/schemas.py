"""Explicit schemas of the three staging tables.

No type is declared by the source scripts; these are inferred from how each
column is used (compared as a date, summed as money, cast from text ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

DOG_STAGE = T.StructType([
    T.StructField("FID", T.LongType(), True),
    T.StructField("Dog_Number", T.LongType(), True),
    T.StructField("Kept_At_Suburb", T.StringType(), True),
    T.StructField("Kept_At_Post_Code", T.StringType(), True),
    T.StructField("Kept_At_Town", T.StringType(), True),
    T.StructField("Date_Of_Birth", T.DateType(), True),
    T.StructField("Animal_Sex", T.StringType(), True),
    T.StructField("Primary_Breed", T.StringType(), True),
    T.StructField("Primary_Colour", T.StringType(), True),
    T.StructField("Active_Dog_Record", T.StringType(), True),
    T.StructField("Fee_Description", T.StringType(), True),
    T.StructField("hash_binary", T.StringType(), True),
])

REGISTRATION_STAGE = T.StructType([
    T.StructField("FID", T.LongType(), True),
    T.StructField("Registration_ID", T.LongType(), True),
    T.StructField("Dog_Number", T.LongType(), True),
    T.StructField("Registration_From", T.DateType(), True),
    T.StructField("Registration_To", T.DateType(), True),
    T.StructField("Effective_Flag", T.StringType(), True),
    T.StructField("Effective_Date", T.DateType(), True),
    T.StructField("Calculated_Fee", MONEY, True),
    T.StructField("Fee_Code", T.StringType(), True),
    T.StructField("Fee_Code_Description", T.StringType(), True),
    # dirty free text in the source; parsed with TRY_CAST where needed
    T.StructField("Amount_Paid", T.StringType(), True),
    T.StructField("hash_binary", T.StringType(), True),
])

TRANSACTION_STAGE = T.StructType([
    T.StructField("FID", T.LongType(), True),
    T.StructField("Account_Number", T.LongType(), True),
    T.StructField("Type_Of_Account", T.StringType(), True),
    T.StructField("Transaction_Date", T.DateType(), True),
    T.StructField("Transaction_Value", MONEY, True),
    T.StructField("Transaction_Type", T.StringType(), True),
    T.StructField("hash_binary", T.StringType(), True),
])

STAGE_SCHEMAS = {
    "Dog_Stage": DOG_STAGE,
    "Dog_Registration_Stage": REGISTRATION_STAGE,
    "Dog_Transaction_Stage": TRANSACTION_STAGE,
}


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Cast the columns of ``schema`` (first, in its order; one that ``df``
    lacks is NULL) and keep every other column of ``df`` as it is.

    A date column that arrives as a timestamp stays one, so times of day take
    part in comparisons. ``lenient`` turns text that does not parse into NULL
    (see :func:`regilens.sources.staging.parse_failures`) instead of an error."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def cast(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        timed = isinstance(f.dataType, T.DateType) and isinstance(have[f.name], (T.TimestampType, T.TimestampNTZType))
        to = have[f.name] if timed else f.dataType
        c = F.col(f"`{f.name}`")
        return (c.try_cast(to) if lenient else c.cast(to)).alias(f.name)

    known = set(schema.fieldNames())
    return df.select(*[cast(f) for f in schema.fields], *[F.col(f"`{c}`") for c in df.columns if c not in known])
