"""Analytic queries over the clean star (population, late payments,
discounts, registration lifecycle, geography, time series).

Shape of every plan:

* predicates on event type and date ranges are plain comparisons / LIKE, so
  they are pushed into the Parquet scan of the transaction fact;
* the transaction fact -- the big table -- is reduced by a keyed aggregation
  with map-side partial aggregation before anything is joined to it;
* joins between the registration fact and the dog dimension pre-aggregate the
  dimension side per join key, so a repeated key multiplies counts instead of
  producing pairs (see :mod:`regilens.operators.joins`);
* no broadcast is forced: AQE switches a join to broadcast from the measured
  size of a side and keeps sort-merge (with skew splitting) otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regilens.functions import constants as K
from regilens.functions.expressions import (
    any_like,
    equals_text,
    null_flag,
    rate,
    year_at_least,
    year_below,
)
from regilens.operators.joins import JOIN_COUNT, anti_lookup, join_count, key_flags, pair_counts

KEY = K.REGISTRATION_KEY
DOG_KEY = "Dog_Number"
GEO = "Kept_At_Suburb"
TYPE = "Transaction_Type"
TDATE = "Transaction_Date"


def _tiebreak(df: DataFrame, column: str = "FID") -> list[str]:
    """The row id, when the table has one, as a last (hidden) sort key: a
    global sort range-partitions on its keys and cannot split a run of equal
    keys, so a unique trailing key keeps hot values spread."""
    return [column] if column in df.columns else []


def late_pred(type_col: str = TYPE, value: str = K.LATE_PAYMENT, case_insensitive: bool = False,
              ignore_trailing_spaces: bool = False) -> Column:
    """Transactions of one exact type (default: late payment penalty)."""
    return equals_text(type_col, value, case_insensitive, ignore_trailing_spaces)


def discount_pred(patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A, type_col: str = TYPE,
                  case_insensitive: bool = False) -> Column:
    """Transactions whose type matches a discount pattern set."""
    return any_like(type_col, patterns, case_insensitive)


# E01 - E03 ---------------------------------------------------------------------
def inspect(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


# E04 -----------------------------------------------------------------------------
def row_count(df: DataFrame, name: str = "Total_Dogs") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# E05 / E24 ---------------------------------------------------------------------
def missing_summary(df: DataFrame, columns: Mapping[str, str], total_name: str) -> DataFrame:
    """One pass: ``SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END)`` per output name
    plus ``COUNT(*)``."""
    aggs = [F.sum(null_flag(c)).alias(out) for out, c in columns.items()]
    return df.agg(*aggs, F.count(F.lit(1)).alias(total_name))


# E06 / E07 ---------------------------------------------------------------------
def count_by(df: DataFrame, column: str = GEO, name: str = "Dog_Count", drop_null: bool = True,
             ascending: bool = False) -> DataFrame:
    src = df.filter(F.col(column).isNotNull()) if drop_null else df
    out = src.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.col(name).asc() if ascending else F.col(name).desc(), F.col(column).asc())


def rare_groups(df: DataFrame, column: str = GEO, below: int = K.RARE_GROUP_BELOW,
                name: str = "Dog_Count") -> DataFrame:
    out = (df.filter(F.col(column).isNotNull())
             .groupBy(column).agg(F.count(F.lit(1)).alias(name))
             .filter(F.col(name) < below))
    return out.orderBy(F.col(name).asc(), F.col(column).asc())


# E08 -----------------------------------------------------------------------------
def group_count_stats(df: DataFrame, column: str = GEO) -> DataFrame:
    """Average (integer-truncated), min, max and exact median
    (``PERCENTILE_CONT(0.5)``) of the per-group row counts.

    The statistics are read off the *histogram of group sizes* (size ->
    number of groups): distinct sizes d1 < d2 < ... < dm of groups that
    together hold N rows satisfy m(m+1)/2 <= N, so the single ordered pass
    that locates the middle ranks sees at most sqrt(2N) rows, however many
    groups there are. No group list is ever gathered in one task."""
    counts = (df.filter(F.col(column).isNotNull())
                .groupBy(column).agg(F.count(F.lit(1)).alias("Dog_Count")))
    hist = counts.groupBy("Dog_Count").agg(F.count(F.lit(1)).alias("__f"))
    upto = Window.orderBy("Dog_Count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(1))
    h = (hist.withColumn("__cum", F.sum("__f").over(upto))
             .withColumn("__n", F.sum("__f").over(everything)))
    lo = F.floor((F.col("__n") - 1) / 2)   # 0-based middle ranks
    hi = F.ceil((F.col("__n") - 1) / 2)
    first = F.col("__cum") - F.col("__f")  # 0-based rank of the first group of this size
    covers = lambda r: (first <= r) & (r < F.col("__cum"))
    return h.agg(
        # integer AVG over groups = total rows div number of groups
        F.expr("sum(Dog_Count * __f) div sum(__f)").alias("Avg_Dogs_Per_Suburb"),
        F.min("Dog_Count").alias("Min_Dogs"),
        F.max("Dog_Count").alias("Max_Dogs"),
        ((F.max(F.when(covers(lo), F.col("Dog_Count"))) + F.max(F.when(covers(hi), F.col("Dog_Count"))))
         / F.lit(2.0)).alias("Median_Dogs"),
    )


# E09 -----------------------------------------------------------------------------
def event_count(txn: DataFrame, predicate: Column | None = None, name: str = "LatePayment_Count") -> DataFrame:
    src = txn if predicate is None else txn.filter(predicate)
    return src.agg(F.count(F.lit(1)).alias(name))


# E10 -----------------------------------------------------------------------------
def monthly_counts(txn: DataFrame, predicate: Column | None = None, min_year: int | None = None,
                   name: str = "Transaction_Count", date_col: str = TDATE) -> DataFrame:
    src = txn if predicate is None else txn.filter(predicate)
    if min_year is not None:
        src = src.filter(year_at_least(date_col, min_year))
    return (src.groupBy(F.year(date_col).alias("Year"), F.month(date_col).alias("Month"))
               .agg(F.count(F.lit(1)).alias(name))
               .orderBy("Year", "Month"))


# E11 -----------------------------------------------------------------------------
def historic_dates(txn: DataFrame, before_year: int = 2000, date_col: str = TDATE,
                   name: str = "Count_Records") -> DataFrame:
    return (txn.filter(year_below(date_col, before_year))
               .groupBy(date_col).agg(F.count(F.lit(1)).alias(name))
               .orderBy(F.col(name).desc(), F.col(date_col).asc()))


# shared: registration x dog counts per (key, geo) --------------------------------
def registration_geo(reg: DataFrame, dog: DataFrame, key: str = KEY, dog_key: str = DOG_KEY,
                     geo: str = GEO) -> DataFrame:
    """``(key, geo, c)``: rows of ``reg JOIN dog ON dog_key`` per key and geo
    (NULL geo and NULL key kept as groups). The dog side is first reduced to
    one row per (dog_key, geo), so a dog number repeated in the dimension
    weights the registrations instead of multiplying them."""
    dims = (dog.filter(F.col(dog_key).isNotNull())
               .groupBy(dog_key, geo).agg(F.count(F.lit(1)).alias("__d")))
    return (reg.select(key, dog_key).filter(F.col(dog_key).isNotNull())
               .join(dims, dog_key, "inner")
               .groupBy(key, geo).agg(F.sum(join_count(F.col("__d"))).cast(JOIN_COUNT).alias("c")))


# E12 / E23 ---------------------------------------------------------------------
def event_rate_by(reg: DataFrame, dog: DataFrame, txn: DataFrame, predicate: Column,
                  count_name: str, rate_name: str, total_name: str = "Total_Registrations",
                  key: str = KEY, dog_key: str = DOG_KEY, geo: str = GEO,
                  rg: DataFrame | None = None) -> DataFrame:
    """Row-level event rate per geo: every (registration, dog) row with a known
    geo is left-joined to every flagged (transaction, registration, dog) row
    of its key; the rate is matched rows over all joined rows.

    Computed without the fan-out: with ``n`` = flagged rows of a key, a
    registration row contributes ``n`` to the numerator and ``max(n, 1)`` to
    the denominator. ``n`` = flagged transactions of the key x
    (registration, dog) rows of the key. Counts are exact DECIMAL(38,0):
    under skew the number of joined rows passes 2^63. ``rg`` may supply a
    precomputed :func:`registration_geo`."""
    rg = registration_geo(reg, dog, key, dog_key, geo) if rg is None else rg
    # w_k: (registration, dog) rows of the key over *all* geos (NULL geo too);
    # a window over the aggregated (key, geo) rows -- at most one row per geo
    # per key -- so the join aggregate is computed once and a hot key is small
    rgw = rg.withColumn("__w", F.sum("c").over(Window.partitionBy(key)).cast(JOIN_COUNT))
    flagged = (txn.filter(predicate & F.col(key).isNotNull())
                  .groupBy(key).agg(F.count(F.lit(1)).alias("__t")))
    zero, one = F.lit(0).cast(JOIN_COUNT), F.lit(1).cast(JOIN_COUNT)
    n = F.coalesce((join_count(F.col("__t")) * F.col("__w")).cast(JOIN_COUNT), zero)
    out = (rgw.filter(F.col(geo).isNotNull())
              .join(flagged, key, "left")
              .groupBy(geo)
              .agg(F.sum((F.col("c") * n).cast(JOIN_COUNT)).cast(JOIN_COUNT).alias(count_name),
                   F.sum((F.col("c") * F.greatest(n, one)).cast(JOIN_COUNT)).cast(JOIN_COUNT).alias(total_name)))
    out = out.withColumn(rate_name, rate(F.col(count_name), F.col(total_name)))
    return out.select(geo, count_name, total_name, rate_name).orderBy(F.col(rate_name).desc(), F.col(geo))


# E13 -----------------------------------------------------------------------------
def event_count_by_category(txn: DataFrame, reg: DataFrame, predicate: Column,
                            category: str = "Fee_Code_Description", name: str = "LatePayment_Count",
                            key: str = KEY) -> DataFrame:
    """Rows of ``txn(predicate) JOIN reg ON key`` per registration category."""
    out = pair_counts(txn, reg, key, right_groups=[category], left_where=predicate, name=name)
    return out.orderBy(F.col(name).desc(), F.col(category))


# E14 -----------------------------------------------------------------------------
def event_count_by_geo(txn: DataFrame, reg: DataFrame, dog: DataFrame, predicate: Column,
                       name: str = "LatePayment_Count", key: str = KEY, dog_key: str = DOG_KEY,
                       geo: str = GEO, rg: DataFrame | None = None) -> DataFrame:
    """Rows of ``txn(predicate) JOIN reg JOIN dog`` per non-NULL geo."""
    rg = registration_geo(reg, dog, key, dog_key, geo) if rg is None else rg
    rg = rg.filter(F.col(geo).isNotNull() & F.col(key).isNotNull())
    flagged = (txn.filter(predicate & F.col(key).isNotNull())
                  .groupBy(key).agg(F.count(F.lit(1)).alias("__t")))
    out = (rg.join(flagged, key, "inner")
             .groupBy(geo).agg(F.sum((F.col("c") * join_count(F.col("__t"))).cast(JOIN_COUNT))
                               .cast(JOIN_COUNT).alias(name)))
    return out.orderBy(F.col(name).desc(), F.col(geo))


# E15 -----------------------------------------------------------------------------
def matching_types(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                   type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    return txn.filter(any_like(type_col, patterns, case_insensitive)).select(type_col).distinct()


# E16 -----------------------------------------------------------------------------
def key_presence(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A, key: str = KEY,
                 type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    """``SUM(CASE WHEN ... THEN 1 END)`` without ELSE: NULL, not 0, when no row
    matches."""
    src = txn.filter(any_like(type_col, patterns, case_insensitive))
    return src.agg(F.sum(F.when(F.col(key).isNull(), F.lit(1))).alias("NullRegID"),
                   F.sum(F.when(F.col(key).isNotNull(), F.lit(1))).alias("HasRegID"))


# E17 -----------------------------------------------------------------------------
def flag_events(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A, name: str = "IsDiscount",
                key: str = KEY, type_col: str = TYPE, date_col: str = TDATE, sort: bool = True, case_insensitive: bool = False) -> DataFrame:
    """Every transaction with a 0/1 flag. The sort (flagged first) carries the
    other columns and the row id as tie-breakers, so the range partitioning
    behind it splits the two flag values -- and any run of identical rows --
    across many partitions."""
    tie = _tiebreak(txn)
    out = txn.select(key, date_col, type_col,
                     F.when(any_like(type_col, patterns, case_insensitive), F.lit(1)).otherwise(F.lit(0)).alias(name), *tie)
    if sort:
        out = out.orderBy(F.col(name).desc(), F.col(key), F.col(date_col), F.col(type_col), *tie)
    return out.drop(*tie)


# E18 -----------------------------------------------------------------------------
def count_by_type(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                  name: str = "Discount_Count", type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    return (txn.filter(any_like(type_col, patterns, case_insensitive))
               .groupBy(type_col).agg(F.count(F.lit(1)).alias(name))
               .orderBy(F.col(name).desc(), F.col(type_col)))


# E19 -----------------------------------------------------------------------------
def repeated_events(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                    keys: Sequence[str] = (KEY, TYPE, TDATE), name: str = "Duplicate_Count",
                    type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    """Same key, type and date more than once (the value is not compared)."""
    return (txn.filter(any_like(type_col, patterns, case_insensitive))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
               .filter(F.col(name) > 1)
               .orderBy(F.col(name).desc(), *[F.col(k) for k in keys]))


# E20 -----------------------------------------------------------------------------
def events_after_first(txn: DataFrame, first_predicate: Column, then_predicate: Column,
                       key: str = KEY, date_col: str = TDATE, first_name: str = "LateDate",
                       then_name: str = "DiscountDate") -> DataFrame:
    """Events of one kind dated strictly after the key's first event of
    another kind. The first-event side is one row per key (aggregated), so
    the join is many-to-one and emits at most one row per later event. The
    join key is a struct of the key: that puts an exchange between the
    aggregate and the join, and only then can the skew join split a hot key
    (it never splits a side that an aggregate feeds directly)."""
    first = (txn.filter(first_predicate & F.col(key).isNotNull())
                .groupBy(key).agg(F.min(date_col).alias(first_name)))
    tie = _tiebreak(txn)
    later = (txn.filter(then_predicate & F.col(key).isNotNull())
                .select(key, F.col(date_col).alias(then_name), *tie))
    first = first.withColumnRenamed(key, "__key")
    return (later.join(first, F.struct(F.col(key).alias("k")) == F.struct(F.col("__key").alias("k")), "inner")
                 .filter(F.col(then_name) > F.col(first_name))
                 .orderBy(then_name, key, first_name, *tie)
                 .select(key, then_name, first_name))


# E21 -----------------------------------------------------------------------------
def discount_value_outliers(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                            low: float = K.DISCOUNT_VALUE_LOW, high: float = K.DISCOUNT_VALUE_HIGH,
                            value_col: str = "Transaction_Value", type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    v = F.col(value_col)
    # (value, type) has few distinct values; the hidden row-id tie-break gives
    # the range partitioning behind the global sort something to split on
    return (txn.filter(any_like(type_col, patterns, case_insensitive) & ((v < low) | (v > high)))
               .orderBy(value_col, type_col, *_tiebreak(txn))
               .select(type_col, value_col))


# E22 -----------------------------------------------------------------------------
def orphan_events(txn: DataFrame, reg: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_A,
                  name: str = "Count_NoRegistration", key: str = KEY, type_col: str = TYPE, case_insensitive: bool = False) -> DataFrame:
    """Events whose key has no registration (NULL keys included), per type.
    Events are first counted per (key, type) -- map-side -- so the anti join
    moves one row per key and type, not one per event."""
    per_key = (txn.filter(any_like(type_col, patterns, case_insensitive))
                  .groupBy(key, type_col).agg(F.count(F.lit(1)).alias("__n")))
    known = reg.select(key).filter(F.col(key).isNotNull()).distinct()
    return (per_key.join(known, key, "left_anti")
                   .groupBy(type_col).agg(F.sum("__n").alias(name)))


# E25 -----------------------------------------------------------------------------
def unmatched(reg: DataFrame, txn: DataFrame, key: str = KEY,
              columns: Sequence[str] = (KEY, DOG_KEY, "Registration_From", "Registration_To")) -> DataFrame:
    """Registrations with no transaction (NULL keys never match, so they are
    kept; they are salted by FID so they do not pile onto one reducer). The
    transaction side is reduced to its distinct keys first."""
    keys = txn.select(key).filter(F.col(key).isNotNull()).distinct()
    spread = "FID" if "FID" in reg.columns else None
    return anti_lookup(reg, keys, key, spread=spread).select(*columns)


# E26 -----------------------------------------------------------------------------
def event_date_range(txn: DataFrame, patterns: Iterable[str] = K.DISCOUNT_PATTERNS_C,
                     date_col: str = TDATE, type_col: str = TYPE,
                     names: tuple[str, str] = ("FirstDiscount", "LastDiscount"), case_insensitive: bool = False) -> DataFrame:
    return (txn.filter(any_like(type_col, patterns, case_insensitive))
               .agg(F.min(date_col).alias(names[0]), F.max(date_col).alias(names[1])))


# E27 -----------------------------------------------------------------------------
def shared_flags(txn: DataFrame | None, flags: DataFrame | None, wanted: Mapping[str, tuple[str, Column]],
                 key: str = KEY) -> DataFrame:
    """Per-key 0/1 flags named as the caller wants them: taken from a
    precomputed flag table (``flags``, columns named by ``wanted[..][0]``)
    when one is given, else computed from ``txn`` with the predicates."""
    if flags is not None:
        return flags.select(key, *[F.col(src).alias(name) for name, (src, _) in wanted.items()])
    return key_flags(txn, key, {name: pred for name, (_, pred) in wanted.items()})


def suburb_scorecard(reg: DataFrame, dog: DataFrame, txn: DataFrame | None,
                     late: Column | None = None, discount: Column | None = None,
                     key: str = KEY, dog_key: str = DOG_KEY, geo: str = GEO,
                     flags: DataFrame | None = None, rg: DataFrame | None = None) -> DataFrame:
    """Per geo: distinct registrations, distinct registrations with a late
    penalty / a discount, and their shares.

    A key counts as late in a geo when it has a late transaction (a key that
    is in the geo's base already joins a registration and a dog, so the
    flagged side's own star join adds nothing). Flags are one row per key
    from a single aggregation of the transaction fact, so the distinct counts
    become plain counts over distinct (geo, key) pairs: no Expand, no second
    star join. ``flags`` may supply a precomputed flag table with columns
    ``late`` and ``disc_b`` (see :mod:`regilens.plans.dashboard`), ``rg`` a
    precomputed :func:`registration_geo`."""
    late = late_pred() if late is None else late
    discount = discount_pred(K.DISCOUNT_PATTERNS_B) if discount is None else discount
    if rg is not None:  # precomputed (key, geo) pairs: already distinct
        base = rg.filter(F.col(geo).isNotNull()).select(geo, key)
    else:
        dims = dog.filter(F.col(geo).isNotNull() & F.col(dog_key).isNotNull()).select(dog_key, geo).distinct()
        base = (reg.select(key, dog_key).filter(F.col(dog_key).isNotNull())
                   .join(dims, dog_key, "inner")
                   .select(geo, key).distinct())
    kf = shared_flags(txn, flags, {"__late": ("late", late), "__disc": ("disc_b", discount)}, key)
    j = base.join(kf, key, "left")
    out = j.groupBy(geo).agg(
        F.count(F.col(key)).alias("Total_Registrations"),
        F.count(F.when(F.col("__late") == 1, F.col(key))).alias("LatePayment_Count"),
        F.count(F.when(F.col("__disc") == 1, F.col(key))).alias("Discount_Count"),
    )
    out = (out.withColumn("LatePayment_Rate", rate(F.col("LatePayment_Count"), F.col("Total_Registrations")))
              .withColumn("Discount_Rate", rate(F.col("Discount_Count"), F.col("Total_Registrations"))))
    return (out.select(geo, "Total_Registrations", "LatePayment_Count", "LatePayment_Rate",
                       "Discount_Count", "Discount_Rate")
               .orderBy(F.col("LatePayment_Rate").desc_nulls_last(), F.col(geo)))


# E28 -----------------------------------------------------------------------------
def yearly_counts(reg: DataFrame, date_col: str = "Registration_From", min_year: int = K.TREND_MIN_YEAR,
                  name: str = "Registration_Count") -> DataFrame:
    return (reg.filter(year_at_least(date_col, min_year))
               .groupBy(F.year(date_col).alias("Year"))
               .agg(F.count(F.lit(1)).alias(name))
               .orderBy("Year"))


# E29 -----------------------------------------------------------------------------
def missing_by_year(reg: DataFrame, date_col: str = "Registration_From",
                    columns: Mapping[str, str] | None = None, min_year: int = K.TREND_MIN_YEAR,
                    total_name: str = "Total_Registrations") -> DataFrame:
    columns = columns or {"Null_AmountPaid": "Amount_Paid", "Null_EffectiveDate": "Effective_Date"}
    aggs = [F.sum(null_flag(c)).alias(out) for out, c in columns.items()]
    return (reg.filter(year_at_least(date_col, min_year))
               .groupBy(F.year(date_col).alias("Year"))
               .agg(*aggs, F.count(F.lit(1)).alias(total_name))
               .orderBy("Year"))


# E30 -----------------------------------------------------------------------------
def monthly_activity(txn: DataFrame, specs: Mapping[str, Column] | None = None,
                     min_year: int | None = K.TREND_MIN_YEAR, date_col: str = TDATE,
                     total_name: str = "TotalTransactions") -> DataFrame:
    """One pass over the fact: a conditional count per event class plus the
    total, per calendar month (a manual pivot)."""
    if specs is None:
        specs = {"LatePayments": late_pred(), "PromptPayments": late_pred(value=K.PROMPT_PAYMENT),
                 "Discounts": discount_pred()}
    src = txn if min_year is None else txn.filter(year_at_least(date_col, min_year))
    aggs = [F.sum(F.when(p, F.lit(1)).otherwise(F.lit(0))).alias(n) for n, p in specs.items()]
    return (src.groupBy(F.year(date_col).alias("Year"), F.month(date_col).alias("Month"))
               .agg(*aggs, F.count(F.lit(1)).alias(total_name))
               .orderBy("Year", "Month"))
