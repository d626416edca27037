"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight schedule w(t) over training time t in [0, 1], linear
from ``start`` to ``end`` times its mean weight. The integral of the schedule
is the source's cumulative token demand D(t) = target * W(t); a document whose
cumulative token offset in its source is c is read at the time t with
D(t) = c, found by inverting the integral in closed form. The documents are
then range-sorted by that position.

* Targets share ``budget`` x (all tokens) by weight; no target may exceed
  ``max_epochs`` times its source's size, and what it can't take is reshared
  by weight among the others (water filling, solved with running sums over the
  one row per source).
* Offsets are prefix sums in a pseudo-random, repeatable order (md5 of the
  doc_id). A hot source isn't one window group: the order is cut into digest
  ranges whose count follows the number of rows; ranges are summed first, the
  running sum over ranges is joined back, and rows are summed inside a range.
* The pass through a source is repeated ``max_epochs`` times at most, the last
  document is cut where the target is reached, so the tokens taken equal the
  rounded target whenever the source can supply it.

Only DataFrame functions; the one value that reaches the driver is a row count.

Edge cases: a NULL text has size 0 (taken 0, no position); a NULL source is a
source of its own, ordered last; rows that repeat a doc_id are rows of their
own, ordered by size and text hash; an empty table gives an empty result; extra
columns (also ones named like the result's) are ignored; if all sources hit
their cap, every target is its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import TOKEN, staged

ROWS_PER_RANGE = 20_000
#: Names of the operator's own columns; ``keep`` can't carry these.
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "reads", "epoch", "tokens")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Integer weights repeating over the sources by code point, NULL last.
    The window runs over one row per source, not over documents."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), ((rank - 1) % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", pick.cast("bigint"))


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """Add ``target``: min(cap, level * weight) with the level that spends the
    budget. Sources are capped in order of cap / weight, so the level is found
    from running sums; the sums are integers, so reruns and other engines agree
    to the last bit."""
    cap = (F.col("source_size") * max_epochs).cast("bigint")
    by_fill = W.orderBy((cap.cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    return (sources
            .withColumn("_cap", cap)
            .withColumn("_caps", F.sum("_cap").over(upto) - F.col("_cap"))
            .withColumn("_left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
            .withColumn("_need", F.sum("source_size").over(whole).cast("double") * F.lit(float(budget)))
            .withColumn("_level", (F.col("_need") - F.col("_caps").cast("double")) / F.col("_left").cast("double"))
            .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap").cast("double"))
            .withColumn("_level", F.min(F.when(F.col("_free"), F.struct(F.col("_caps"), F.col("_level")))).over(whole)["_level"])
            .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap").cast("double"))
                        .otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))))
            .select("source", "source_size", "weight", "target"))


def invert_schedule(share: Column, start: Column, end: Column) -> Column:
    """Time t in [0, 1] at which the integral of a schedule that runs linearly
    from ``start`` to ``end`` has reached ``share`` of its total: the root of
    start * t + (end - start) * t^2 / 2 = share * (start + end) / 2."""
    a = end - start
    disc = F.sqrt(F.greatest(start * start + a * share * (start + end), F.lit(0.0)))
    # 2c / (b + sqrt(b^2 + 2ac)) stays exact when the schedule is flat (a = 0)
    return F.least(F.lit(1.0), share * (start + end) / F.greatest(start + disc, F.lit(1e-300)))


def curriculum(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2,
               schedule: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)),
               keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken
    (tokens the mix takes, repeats counted), position (time of the first
    reading; NULL if never read) and reads, an array of (epoch, position,
    tokens). ``schedule`` gives (start, end) factors of the weight, repeating
    over the sources like ``cycle``. ``keep`` names further columns to carry."""
    slim = staged(docs.select("doc_id", "source", token_count(F.col("text")).alias("size"),
                              F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_at"),
                              F.xxhash64("text").alias("_text"), *[F.col(c) for c in keep]), "mix-sizes")
    digits = 0
    rows = slim.count()
    while rows > ROWS_PER_RANGE * 16 ** digits:
        digits += 1
    # NULL-safe keys: a source and whether it is NULL
    slim = slim.withColumn("_range", F.substring("_at", 1, digits) if digits else F.lit("")) \
        .withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    ranges = slim.groupBy("_s", "_n", "_range").agg(F.sum("size").alias("_sum"))
    sources = ranges.groupBy("_s", "_n").agg(F.sum("_sum").alias("source_size")) \
        .withColumn("source", F.when(~F.col("_n"), F.col("_s")))
    nth = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedule) + 1
    targets = water_fill(cycled_weights(sources, cycle), budget, max_epochs)
    pick = lambda i: F.element_at(F.array(*[F.lit(float(p[i])) for p in schedule]), nth.cast("int"))
    targets = targets.withColumn("_from", pick(0)).withColumn("_to", pick(1)) \
        .withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).drop("source", "weight")
    before = F.sum("_sum").over(W.partitionBy("_s", "_n").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = staged(ranges.withColumn("_before", F.coalesce(before, F.lit(0)))
                    .join(targets, ["_s", "_n"]).drop("_sum"), "mix-ranges")
    inside = F.sum("size").over(W.partitionBy("_s", "_n", "_range").orderBy("_at", "size", "_text", "doc_id")
                                .rowsBetween(W.unboundedPreceding, -1))
    placed = slim.withColumn("_in", F.coalesce(inside, F.lit(0))) \
        .join(starts, ["_s", "_n", "_range"]).withColumn("_c", F.col("_before") + F.col("_in"))
    goal = F.round(F.col("target")).cast("bigint")

    def read(epoch: int) -> Column:
        c = F.col("_c") + F.lit(epoch) * F.col("source_size")
        tokens = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), goal - c))
        t = invert_schedule(c.cast("double") / F.greatest(F.col("target"), F.lit(1.0)), F.col("_from"), F.col("_to"))
        return F.struct(F.lit(epoch).alias("epoch"), t.alias("position"), tokens.alias("tokens"))

    reads = F.filter(F.array(*[read(e) for e in range(max_epochs)]), lambda r: r["tokens"] > 0)
    placed = placed.withColumn("reads", reads)
    taken = F.aggregate("reads", F.lit(0).cast("bigint"), lambda s, r: s + r["tokens"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                         F.get("reads", F.lit(0))["position"].alias("position"), "reads", *keep)


def range_sorted(mixed: DataFrame) -> DataFrame:
    """Documents in the order of their first reading (never read: last). A
    global sort: range partitions of the position, each sorted."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per reading, range-sorted by position over the whole mix."""
    return (mixed.select(*[c for c in mixed.columns if c not in ("reads", "position", "taken")], F.explode("reads").alias("_r"))
            .select("*", F.col("_r.epoch").alias("epoch"), F.col("_r.position").alias("position"),
                    F.col("_r.tokens").alias("tokens")).drop("_r")
            .orderBy("position", "doc_id", "epoch"))


def op10_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    from ._spark import table
    return range_sorted(curriculum(table(spark, sf_dir, "documents"))) \
        .select("doc_id", "size", "source_size", "target", "taken", "position")


# Independent statement: targets by trying every number of capped sources, offsets by one plain window,
# times by the quadratic's root.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         [1.5, 1.0, 0.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS at0
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST) AS k FROM s),
lv AS (
  SELECT a.k, (1.5::DOUBLE * (SELECT sum(source_size) FROM o)::DOUBLE - coalesce((SELECT sum(cap) FROM o b WHERE b.k < a.k), 0)::DOUBLE)
         / (SELECT sum(weight) FROM o b WHERE b.k >= a.k)::DOUBLE AS level, a.cap, a.weight
  FROM o a),
l AS (SELECT level FROM lv WHERE level * weight <= cap::DOUBLE ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, at0, least(cap::DOUBLE, (SELECT level FROM l) * weight) AS target FROM o),
c AS (
  SELECT d.*, t.source_size, t.target, t.at0, 2.0::DOUBLE - t.at0 AS at1,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - c)) + greatest(0, least(size, round(target)::BIGINT - c - source_size)))::BIGINT AS taken,
       CASE WHEN least(size, round(target)::BIGINT - c) > 0 THEN
         least(1.0::DOUBLE, share * (at0 + at1) / greatest(at0 + sqrt(greatest(at0 * at0 + (at1 - at0) * share * (at0 + at1), 0.0::DOUBLE)), 1e-300::DOUBLE)) END AS position
FROM (SELECT *, c::DOUBLE / greatest(target, 1.0::DOUBLE) AS share FROM c)
"""
