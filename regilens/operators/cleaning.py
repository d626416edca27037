"""Staging -> clean star schema: copy/filter, standardise labels and keys,
remove exact duplicates, row fingerprints.

All transformations are narrow (no shuffle) except :func:`dedup_keep_first`,
which shuffles once on its partition keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import replace_all, starts_with


# C01 / C02 -------------------------------------------------------------------
def build_table(stage: DataFrame) -> DataFrame:
    """Full copy of a staging table (``SELECT * INTO``). Lazy: Spark writes
    it only when the plan is materialised."""
    return stage


# C03 -------------------------------------------------------------------------
def build_fact_transaction(stage: DataFrame, account_type: str = K.REGISTRATION_ACCOUNT,
                           column: str = "Type_Of_Account") -> DataFrame:
    """Keep one account type; the equality is pushed into the Parquet scan."""
    return stage.filter(F.col(column) == F.lit(account_type))


# C04 -------------------------------------------------------------------------
def standardise_prefix(df: DataFrame, column: str = "Kept_At_Suburb",
                       old: str = K.SUBURB_PREFIX_OLD, new: str = K.SUBURB_PREFIX_NEW) -> DataFrame:
    """Rows whose value starts with ``old`` get every occurrence of ``old``
    replaced by ``new`` (SQL ``REPLACE`` semantics); other rows are unchanged."""
    c = F.col(column)
    return df.withColumn(column, F.when(starts_with(df, column, old), replace_all(c, old, new)).otherwise(c))


# C05 -------------------------------------------------------------------------
def recode_values(df: DataFrame, column: str = "Fee_Code_Description",
                  mapping: Mapping[str, str] = K.FEE_LABEL_RECODES) -> DataFrame:
    """Exact-value relabelling in one pass (one projection, any number of pairs)."""
    if not mapping:
        return df
    c = F.col(column)
    expr = None
    for old, new in mapping.items():
        expr = F.when(c == F.lit(old), F.lit(new)) if expr is None else expr.when(c == F.lit(old), F.lit(new))
    return df.withColumn(column, expr.otherwise(c))


# C06 -------------------------------------------------------------------------
def standardise_keys(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename key columns so joins use one name (metadata only)."""
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


# C17 - C19 -------------------------------------------------------------------
def dedup_keep_first(df: DataFrame, keys: Sequence[str], order_by: str = "FID") -> DataFrame:
    """Keep the row with the lowest ``order_by`` for every ``keys`` group
    (NULL keys form one group, as SQL ``PARTITION BY`` does; a NULL
    ``order_by`` sorts first, as in the source database).

    ``row_number() ... = 1`` plans as a *partial* WindowGroupLimit before the
    shuffle, so every map task forwards at most one row per group: a group of
    copies holding a third of the table does not reach one reducer whole."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_by).asc_nulls_first())
    return (df.withColumn("__rn", F.row_number().over(w))
              .filter(F.col("__rn") == 1)
              .drop("__rn"))


# C23 -------------------------------------------------------------------------
def row_hash(df: DataFrame, columns: Iterable[str] | None = None, exclude: Iterable[str] = ("FID",),
             name: str = "Row_Hash") -> DataFrame:
    """SHA-256 fingerprint of the business columns for sources without a
    supplied hash. Each value is encoded as ``<length>:<text>`` and NULL as
    ``~``, so NULL, empty text and separators cannot collide."""
    skip = set(exclude) | {name}
    cols = [c for c in (columns or df.columns) if c not in skip]
    parts = []
    for c in cols:
        s = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return df.withColumn(name, F.sha2(F.concat_ws("|", *parts), 256))


# whole path -------------------------------------------------------------------
def standardise_dog(stage: DataFrame) -> DataFrame:
    return standardise_prefix(build_table(stage))


def standardise_registration(stage: DataFrame) -> DataFrame:
    return standardise_keys(recode_values(build_table(stage)), K.REGISTRATION_KEY_RENAMES)


def standardise_transaction(stage: DataFrame) -> DataFrame:
    return standardise_keys(build_fact_transaction(stage), K.TRANSACTION_KEY_RENAMES)


def dedup_dog(df: DataFrame) -> DataFrame:
    return dedup_keep_first(df, ["Dog_Number", "hash_binary"])


def dedup_registration(df: DataFrame) -> DataFrame:
    return dedup_keep_first(df, [K.REGISTRATION_KEY, "hash_binary"])


def dedup_transaction(df: DataFrame) -> DataFrame:
    return dedup_keep_first(df, [K.REGISTRATION_KEY, "hash_binary"])
