"""Queries with SQL: Spark and DuckDB agree on the test tables, on awkward rows
and on empty tables."""

import os
from collections import Counter

import duckdb
import pytest

from regilens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("data", ["sf0.001", "awkward", "empty"])
def test_matches_sql(spark, tables, name, data):
    folder = SMALL if data == "sf0.001" else tables(data)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        p = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = QUERIES[name](spark, folder)
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    want = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    got = Counter(tuple(r) for r in df.collect())
    assert got == want
    assert data == "empty" or sum(got.values()) > 0


def test_links_to_blocked_hosts_without_pages_count(spark):
    """A host that links to a blocked site which holds no page itself is blocked; its neighbour without links is not."""
    from regilens.llm.url_trust import judge_urls
    rows = [(1, "http://shop.one.com/a", '<a href="http://evil.net/x">'), (2, "http://shop.one.com/b", '<a href="//evil.net/">'),
            (3, "http://blog.two.com/a", "plain"), (4, "http://evil.org/en/", None), (5, "http://a.three.com/", '<a href="http://blog.two.com">')]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert got[1].distrust > 1 and got[3].distrust == 0 and all(r.rule is None for r in got.values())
    without = judge_urls(spark.createDataFrame([(i, u, None) for i, u, _ in rows], "page_id long, url string, html string"))
    assert {r.verdict for r in without.collect()} == {"allow"}


@pytest.mark.parametrize("change", ["none", "lost", "inserted", "replaced", "two lost"])
def test_changed_notices_are_bridged(spark, change):
    from regilens.llm.license_scan import scan
    words = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software".split()
    if change in ("lost", "two lost"):
        del words[7:8 if change == "lost" else 9]
    if change == "inserted":
        words.insert(7, "hereby")
    if change == "replaced":
        words[7] = "towards"
    text = "some words before it " + " ".join(words) + " and some words behind it"
    spans = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[1].collect()
    assert [(s.label, s.start) for s in spans] == [("mit", 4)] and spans[0].cover >= 0.75
