"""Written tables follow their input: reruns, snapshots, lasting names, and
nothing written before it is needed."""

import os
import tempfile
from collections import Counter

from paths import SF_SMOKE
from regilens.plans import build_star, materialise, save_tables
from regilens.plans.dashboard import TABLES, current_dashboard, refresh_dashboard
from regilens.sources import load_stages


def small(spark, dogs):
    stages = load_stages(spark, SF_SMOKE)
    return build_star({**stages, "Dog_Stage": stages["Dog_Stage"].where(f"Dog_Number < {dogs}")})


def test_rerun_reflects_its_input(spark):
    root = tempfile.mkdtemp(prefix="regilens-rerun-")
    assert materialise(spark, small(spark, 150), root).dog.count() == 150
    assert materialise(spark, small(spark, 50), root).dog.count() == 50


def test_a_named_snapshot_is_written_once(spark):
    root = tempfile.mkdtemp(prefix="regilens-snap-")
    first = materialise(spark, small(spark, 50), root, "day1")
    assert first.dog.count() == 50
    again = materialise(spark, small(spark, 50), root, "day1")
    assert again.dog.inputFiles() == first.dog.inputFiles()
    assert materialise(spark, small(spark, 70), root, "day2").dog.count() == 70


def test_tables_are_written_when_needed(spark):
    root = tempfile.mkdtemp(prefix="regilens-lazy-")
    star = materialise(spark, small(spark, 50), root, "s")
    assert star.dog.count() == 50
    assert os.listdir(os.path.join(root, "s")) == ["DimDog"]
    assert star.geo_pairs.count() > 0
    tables = [t for t in os.listdir(os.path.join(root, "s")) if "_audit_" not in t]  # figures lie beside their tables
    assert sorted(tables) == ["DimDog", "FactRegistration", "RegistrationGeo"]


def test_lasting_names(spark):
    root = tempfile.mkdtemp(prefix="regilens-named-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS regilens_test LOCATION '{root}/db'")
    try:
        for dogs in (50, 30):
            names = save_tables(materialise(spark, small(spark, dogs), root), "regilens_test", path=f"{root}/tables")
            assert spark.table(names["DimDog"]).count() == dogs
            assert spark.table("regilens_test.FactTransaction").count() > 0
    finally:
        spark.sql("DROP DATABASE regilens_test CASCADE")


def test_a_refresh_follows_the_star_and_publishes_whole(spark):
    out = tempfile.mkdtemp(prefix="regilens-dash-")
    assert current_dashboard(spark, out) is None
    for dogs in (150, 50):
        star = materialise(spark, small(spark, dogs), tempfile.mkdtemp(prefix="regilens-dash-star-"))
        refresh_dashboard(spark, star, out)
        now = current_dashboard(spark, out)
        assert set(now) == set(TABLES)
        want = star.dog.where("Kept_At_Suburb is not null").count()
        assert now["geo_mart"].agg({"Dog_Count": "sum"}).first()[0] == want
