"""Readers for real staging extracts (Parquet or CSV).

Use these when the three staging tables exist as files; use
:mod:`regilens.sources.fixtures` to derive them from the TPC-H-like test tables.
Columns that the schema does not name are kept: a copy of a staging table is a
full copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampType

from regilens.operators.cleaning import row_hash
from regilens.operators.rescue import RESCUED, unparsed
from regilens.sources.schemas import STAGE_SCHEMAS, conform


def read_stage(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
               date_times: bool = False, rescue: bool = False, **options) -> DataFrame:
    """Read one staging table (``Dog_Stage``, ``Dog_Registration_Stage`` or
    ``Dog_Transaction_Stage``) and conform it to its schema.

    Parquet is read as stored and cast, so column pruning and filter pushdown
    still reach the scan. CSV columns are taken by the *names* in the header,
    whatever their order; text that does not parse as its column's type is
    NULL, and :func:`parse_failures` counts it; with ``rescue`` a VARIANT column
    ``_rescued`` holds such text (see :mod:`regilens.operators.rescue`).
    ``date_times`` reads a CSV's date columns with their time of day."""
    schema = STAGE_SCHEMAS[table]
    if fmt == "csv":
        if date_times:
            schema = StructType([StructField(f.name, TimestampType() if isinstance(f.dataType, DateType) else f.dataType, True)
                                 for f in schema.fields])
        raw = _csv_text(spark, path, options)
        if rescue:
            raw = raw.withColumn(RESCUED, unparsed({f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields
                                                    if f.name in raw.columns and not isinstance(f.dataType, StringType)}))
        if "hash_binary" not in raw.columns:  # the fingerprint is of the typed values
            bare = StructType([f for f in schema.fields if f.name != "hash_binary"])
            raw = _with_row_hash(conform(raw, bare, lenient=True))
        return conform(raw, schema, lenient=True)
    df = spark.read.options(**options).format(fmt).load(path)
    if "hash_binary" not in df.columns:
        df = _with_row_hash(df)
    return conform(df, schema)


#: Label columns of each staging table, and the collation that makes labels equal
#: that differ in case or trailing blanks only. LIKE patterns take trailing blanks
#: as they are (and Spark has no LIKE for the trimming collation), so the column
#: that patterns are matched on ignores case only.
LABELS = {"Dog_Stage": ("Kept_At_Suburb", "Kept_At_Town", "Fee_Description"), "Dog_Registration_Stage": ("Fee_Code_Description",),
          "Dog_Transaction_Stage": ("Type_Of_Account",)}
PATTERN_LABELS = {"Dog_Transaction_Stage": ("Transaction_Type",)}
LABEL_COLLATION, PATTERN_COLLATION = "UTF8_LCASE_RTRIM", "UTF8_LCASE"


def collate_stage(df: DataFrame, table: str) -> DataFrame:
    """The staging table with collated labels: ``=``, GROUP BY, joins and REPLACE
    on them ignore case and trailing blanks from here on. A group shows one of
    its spellings; :func:`folded` gives it one that doesn't depend on the plan."""
    wanted = {**dict.fromkeys(LABELS.get(table, ()), LABEL_COLLATION), **dict.fromkeys(PATTERN_LABELS.get(table, ()), PATTERN_COLLATION)}
    return df.select(*[F.collate(c, wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in df.columns])


def _is_collated(t) -> bool:
    return isinstance(t, StringType) and t.simpleString() != "string"


def plain(df: DataFrame) -> DataFrame:
    """Collated columns as plain strings, spelled as they are."""
    return df.select(*[F.collate(f.name, "UTF8_BINARY").alias(f.name) if _is_collated(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def folded(df: DataFrame) -> DataFrame:
    """Collated columns in lower case without trailing blanks, as plain strings."""
    return df.select(*[F.rtrim(F.lower(F.collate(f.name, "UTF8_BINARY"))).alias(f.name) if _is_collated(f.dataType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _csv_text(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """All columns as text under their header names. With ``enforceSchema``
    off Spark checks every file's header against the first one's, so a file
    with another column order fails instead of being misread."""
    opts = {"header": "true", "mode": "PERMISSIVE", "enforceSchema": "false", **options}
    header = spark.read.options(**opts).csv(path).columns  # the header line only
    return spark.read.options(**opts).schema(StructType([StructField(c, StringType(), True) for c in header])).csv(path)


def parse_failures(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """One row: for every typed column of a CSV extract, how many values are
    present but do not parse (these read as NULL)."""
    raw = _csv_text(spark, path, options)
    typed = [f for f in STAGE_SCHEMAS[table].fields if f.name in raw.columns and not isinstance(f.dataType, StringType)]
    return raw.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in typed])


def _with_row_hash(df: DataFrame) -> DataFrame:
    """Extracts without the supplied row fingerprint get one computed from
    their business columns (everything but the surrogate FID and rescued text)."""
    return row_hash(df, exclude=("FID", RESCUED), name="hash_binary")


def read_stages(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet", collated: bool = False,
                **options) -> dict[str, DataFrame]:
    """The staging tables by name; ``collated`` as in :func:`collate_stage`."""
    stages = {t: read_stage(spark, p, t, fmt, **options) for t, p in paths.items()}
    return {t: collate_stage(df, t) for t, df in stages.items()} if collated else stages
