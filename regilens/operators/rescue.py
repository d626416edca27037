"""Values that are present but don't parse, kept beside the row.

A typed read turns such text into NULL. Here a VARIANT column holds an object
{column: text} of them (NULL where all parse), so a row can be traced and
mended later without reading the extract again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESCUED = "_rescued"


def unparsed(parsed: Mapping[str, Column]) -> Column:
    """VARIANT object of the text of the columns that are not NULL while their
    ``parsed`` form is; NULL if there is none."""
    if not parsed:
        return F.parse_json(F.lit(None).cast("string"))
    failed = F.filter(F.array(*[F.when(F.col(f"`{n}`").isNotNull() & p.isNull(), F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").cast("string").alias("v")))
                                for n, p in parsed.items()]), lambda x: x.isNotNull())
    return F.when(F.size(failed) > 0, F.to_variant_object(F.map_from_entries(failed)))


def rescued_values(df: DataFrame, key: str = "FID", column: str = RESCUED) -> DataFrame:
    """``key, Column_Name, Value_Text``: one row per value that didn't parse."""
    return df.filter(F.col(column).isNotNull()) \
        .select(key, F.explode(F.col(column).cast("map<string,string>")).alias("Column_Name", "Value_Text"))


def rescued_counts(df: DataFrame, column: str = RESCUED) -> DataFrame:
    """``Column_Name, Value_Text, Value_Count``: which texts fail, and how often."""
    return rescued_values(df.withColumn("__one", F.lit(1)), "__one", column) \
        .groupBy("Column_Name", "Value_Text").agg(F.count("*").alias("Value_Count"))
