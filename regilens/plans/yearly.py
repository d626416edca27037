"""Year by year refresh of a lasting fact table.

The table is laid out by :mod:`regilens.operators.dated`. A refresh compares
each year's digest (row count and the sum of the rows' hashes, which doesn't
depend on their order) with the stored one and rewrites the folders of the
years that differ, by dynamic partition overwrite; years that are gone lose
their folder. Only one row per year reaches the driver.

The digests lie beside the table. Those of changed years are taken out before
the files change and put back afterwards, so a refresh that broke off leaves
its years to be rewritten by the next one, whatever that one's extract is. The
input is read twice: give a written table. A reader that starts while years are
replaced can see some of them new and others old."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regilens.operators.dated import YEAR, by_date
from regilens.session import hadoop_path, path_join

DIGEST_SCHEMA = f"{YEAR} int, Rows bigint, Digest decimal(38,0)"


def _hash(df: DataFrame) -> Column:
    """Of all columns by name; tells NULLs in different columns apart."""
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        parts += [F.lit(f.name), F.to_json(c) if isinstance(f.dataType, T.VariantType) else c, c.isNull()]
    return F.xxhash64(*parts)


def year_digests(df: DataFrame, date_col: str) -> DataFrame:
    return df.select(F.year(date_col).alias(YEAR), _hash(df).cast("decimal(38,0)").alias("h")) \
        .groupBy(YEAR).agg(F.count("*").alias("Rows"), F.sum("h").cast("decimal(38,0)").alias("Digest"))


def _digest_root(path: str) -> str:
    return path.rstrip("/") + "_digests"


def _stored(spark: SparkSession, path: str) -> dict:
    """Year -> (rows, digest) of the newest finished digest table; none: empty."""
    fs, root = hadoop_path(spark, _digest_root(path))
    done = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else [])]
    done = sorted(p.getName() for p in done if fs.exists(hadoop_path(spark, path_join(str(p), "_SUCCESS"))[1]))
    if not done:
        return {}
    return {r[YEAR]: (r["Rows"], r["Digest"]) for r in spark.read.schema(DIGEST_SCHEMA).parquet(path_join(_digest_root(path), done[-1])).collect()}


def _store(spark: SparkSession, path: str, digests: dict) -> None:
    """A new digest table; its number is above those of the others, which go."""
    fs, root = hadoop_path(spark, _digest_root(path))
    old = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else [])]
    number = 1 + max([int(p.getName().split("-")[0]) for p in old], default=0)
    rows = [(y, n, d) for y, (n, d) in digests.items()]
    spark.createDataFrame(rows, DIGEST_SCHEMA).coalesce(1).write.parquet(path_join(_digest_root(path), f"{number:012d}-{uuid.uuid4().hex}"))
    for p in old:
        fs.delete(p, True)


def refresh_years(spark: SparkSession, df: DataFrame, path: str, date_col: str) -> list[int | None]:
    """Bring the table at ``path`` to ``df``; returns the years rewritten or
    removed (None: rows without a date). After it the table equals a full
    rebuild from ``df``."""
    new = {r[YEAR]: (r["Rows"], r["Digest"]) for r in year_digests(df, date_col).collect()}  # one row per year
    old = _stored(spark, path)
    fs, at = hadoop_path(spark, path)
    held = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().startswith(f"{YEAR}=")]
    year_of = lambda p: int(v) if (v := p.getName().split("=", 1)[1]).lstrip("-").isdigit() else None
    folders = {year_of(p): p for p in held}
    changed = [y for y in new if old.get(y) != new[y] or y not in folders]
    gone = [y for y in folders if y not in new]
    if not changed and not gone:
        return []
    _store(spark, path, {y: d for y, d in new.items() if y not in changed})
    if changed:
        years = [y for y in changed if y is not None]
        wanted = F.year(date_col).isin(years) if years else F.lit(False)
        if None in changed:
            wanted = wanted | F.col(date_col).isNull()
        by_date(df.filter(wanted), date_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR).parquet(path)
    for y in gone:
        fs.delete(folders[y], True)
    _store(spark, path, new)
    return sorted([*changed, *gone], key=lambda y: (y is None, y or 0))


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """The table with its year column, for :mod:`regilens.operators.dated`."""
    return spark.read.parquet(path)
