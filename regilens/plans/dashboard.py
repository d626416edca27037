"""Dashboard refresh: every dashboard table from one pass over the
transaction fact.

Run one by one, the marts each aggregate the transaction fact for their own
per-key flags. The refresh job computes one flag table -- late penalty,
prompt payment, discount set A, discount set B, one row per key -- in a
single scan, writes it as a stage, builds the suburb scorecard once from it,
and derives every other table from those two. A refresh writes all tables
into a folder of its own and, when the last one is finished, publishes it:
readers see the tables of one whole refresh, the latest."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from regilens.functions import constants as K
from regilens.operators import analytics as A
from regilens.operators import marts as M
from regilens.operators.joins import key_flags
from regilens.plans.star import Star, StagedStar
from regilens.session import hadoop_path, path_join

KEY = K.REGISTRATION_KEY


def key_flag_table(txn: DataFrame) -> DataFrame:
    """One row per registration key with the four event-class flags."""
    return key_flags(txn, KEY, {
        "late": A.late_pred(),
        "prompt": A.late_pred(value=K.PROMPT_PAYMENT),
        "disc_a": A.discount_pred(K.DISCOUNT_PATTERNS_A),
        "disc_b": A.discount_pred(K.DISCOUNT_PATTERNS_B),
    })


TABLES = ("key_flags", "suburb_scorecard", "overview_kpis", "geo_mart", "category_behaviour", "suburb_rankings", "seasonality",
          "late_seasonality", "incentive_uptake", "missing_share", "monthly_activity", "star_wide")


def current_dashboard(spark: SparkSession, out_dir: str) -> dict[str, DataFrame] | None:
    """The tables of the latest finished refresh, or None before the first."""
    fs, p = hadoop_path(spark, path_join(out_dir, "published"))
    if not fs.exists(p):
        return None
    # one empty file per refresh, named by the time it was published
    latest = max((f.getPath().getName() for f in fs.listStatus(p)), default=None)
    if latest is None:
        return None
    version = latest.split(".", 1)[1]
    return {t: spark.read.parquet(path_join(out_dir, version, t)) for t in TABLES}


def refresh_dashboard(spark: SparkSession, star: Star | StagedStar, out_dir: str) -> dict[str, DataFrame]:
    """Write all dashboard tables under ``out_dir`` from the star as it is
    now, publish them, and return them (read back)."""
    version = uuid.uuid4().hex

    def put(name: str, df: DataFrame) -> DataFrame:
        path = path_join(out_dir, version, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    reg, dog, txn = star.registration, star.dog, star.transaction
    flags = put("key_flags", key_flag_table(txn))
    scorecard = put("suburb_scorecard", A.suburb_scorecard(reg, dog, None, flags=flags, rg=star.geo_pairs))
    out = {
        "key_flags": flags,
        "suburb_scorecard": scorecard,
        "overview_kpis": put("overview_kpis", M.overview_kpis(reg, None, flags=flags)),
        "geo_mart": put("geo_mart", M.geo_mart(reg, dog, None, scorecard=scorecard)),
        "category_behaviour": put("category_behaviour", M.category_behaviour(reg, None, flags=flags)),
        "suburb_rankings": put("suburb_rankings", M.suburb_rankings(reg, dog, None, scorecard=scorecard)),
        "seasonality": put("seasonality", M.seasonality(reg)),
        "late_seasonality": put("late_seasonality", M.late_seasonality(reg, txn)),
        "incentive_uptake": put("incentive_uptake", M.incentive_uptake(reg, dog, txn, rg=star.geo_pairs)),
        "missing_share": put("missing_share", M.missing_share(reg)),
        "monthly_activity": put("monthly_activity", A.monthly_activity(txn)),
        "star_wide": put("star_wide", M.star_wide(txn, reg, dog)),
    }
    fs, mark = hadoop_path(spark, path_join(out_dir, "published", f"{time.time_ns():020d}.{version}"))
    fs.create(mark).close()
    return out
