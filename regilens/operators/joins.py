"""Join building blocks that never enumerate the pairs inside a key.

The star's relationships are only *intended* one-to-many: a registration key
can repeat in the registration fact, and a dog number can repeat in the dog
dimension. A plain join then emits every (left, right) pair of a key, which
for a hot key is quadratic. These helpers aggregate each side to one row per
(key, grouping columns) *before* the join -- partial aggregation runs map-side,
so a hot key is collapsed before it is shuffled -- and multiply the counts,
which is exactly the number of pairs the plain join would have produced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counts of *join rows* are products of per-key counts. With a key holding a
# third of two tables, such a product passes 2^63 long before anything could
# enumerate the rows, so they are carried as exact 38-digit decimals.
JOIN_COUNT = "decimal(38,0)"


def join_count(c: Column) -> Column:
    return c.cast(JOIN_COUNT)


def pair_counts(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                left_groups: Sequence[str] = (), right_groups: Sequence[str] = (),
                left_where: Column | None = None, right_where: Column | None = None,
                name: str = "n", right_on: str | Sequence[str] | None = None) -> DataFrame:
    """Number of rows ``left JOIN right ON on`` yields per (left groups,
    right groups), as ``(groups..., name)``, without producing those rows.

    NULL keys never match (they are dropped before the join)."""
    lk = [on] if isinstance(on, str) else list(on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    lsrc = left if left_where is None else left.filter(left_where)
    rsrc = right if right_where is None else right.filter(right_where)
    lkeys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(lk)]
    rkeys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(rk)]
    for k in lk:
        lsrc = lsrc.filter(F.col(k).isNotNull())
    for k in rk:
        rsrc = rsrc.filter(F.col(k).isNotNull())
    knames = [f"__k{i}" for i in range(len(lk))]
    lc = lsrc.select(*lkeys, *left_groups).groupBy(*knames, *left_groups).agg(F.count(F.lit(1)).alias("__lc"))
    rc = rsrc.select(*rkeys, *right_groups).groupBy(*knames, *right_groups).agg(F.count(F.lit(1)).alias("__rc"))
    return (lc.join(rc, knames, "inner")
              .groupBy(*left_groups, *right_groups)
              .agg(F.sum(join_count(F.col("__lc")) * join_count(F.col("__rc"))).cast(JOIN_COUNT).alias(name)))


def key_flags(df: DataFrame, key: str, flags: Mapping[str, Column],
              prefilter: bool = True) -> DataFrame:
    """One row per non-NULL key with a 0/1 column per flag: 1 when any row of
    the key satisfies the flag's predicate. Rows matching no flag are dropped
    before the shuffle (``prefilter``), so only flagged keys move."""
    src = df.filter(F.col(key).isNotNull())
    if prefilter and flags:
        anyflag = None
        for p in flags.values():
            anyflag = p if anyflag is None else (anyflag | p)
        src = src.filter(anyflag)
    aggs = [F.max(F.when(p, F.lit(1)).otherwise(F.lit(0))).alias(n) for n, p in flags.items()]
    return src.groupBy(key).agg(*aggs)


def _salted_key(df: DataFrame, key: str, spread: str) -> Column:
    """Join key that equals ``(false, key)`` for a real key and
    ``(true, hash(spread))`` for a NULL key: NULL keys still never match, but
    they hash to partitions by ``spread`` instead of all to one."""
    dtype = df.schema[key].dataType
    return F.struct(F.col(key).isNull().alias("n"),
                    F.coalesce(F.col(key), F.xxhash64(F.col(spread)).cast(dtype)).alias("v"))


def _probe_key(df: DataFrame, key: str) -> Column:
    return F.struct(F.lit(False).alias("n"), F.col(key).alias("v"))


def left_lookup(left: DataFrame, right: DataFrame, on: str, spread: str | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (on)`` where ``right`` has at most one row
    per key (so the join never fans out).

    With ``spread`` (a well-spread left column such as a row id), left rows
    with a NULL key -- which can never match -- are salted across partitions
    instead of all landing on one reducer; still one scan, one join."""
    if spread is None:
        return left.join(right, on, "left")
    r = right.withColumnRenamed(on, "__rk")
    cond = _salted_key(left, on, spread) == _probe_key(r, "__rk")
    return left.join(r, cond, "left").drop("__rk")


def anti_lookup(left: DataFrame, right_keys: DataFrame, on: str, spread: str | None = None) -> DataFrame:
    """``left`` rows whose key is not in ``right_keys`` (NULL keys never
    match, so they are kept). ``spread`` salts NULL keys as in
    :func:`left_lookup`."""
    if spread is None:
        return left.join(right_keys, on, "left_anti")
    r = right_keys.select(F.col(on).alias("__rk"))
    return left.join(r, _salted_key(left, on, spread) == _probe_key(r, "__rk"), "left_anti")
