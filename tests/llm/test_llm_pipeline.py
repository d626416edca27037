"""The pipeline against a brute-force version of its stages."""

from collections import Counter

import numpy as np

SF_SMOKE, SF_ORACLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
from test_llm_joins import brute_classes, words

import corpus_pipeline
from regilens.llm.queries import QUERIES


def stage_by_stage(spark, folder, tmp):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"in": docs}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, folder).write.parquet(f"{tmp}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp}/{name}")
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def check(spark, folder, tmp):
    out = stage_by_stage(spark, folder, tmp)
    # language: what goes has no letter (all clean texts stay)
    letter = lambda t: any(c.isalpha() for c in t or "")
    assert Counter(rows(out["language"])) == Counter(x for x in rows(out["in"]) if letter(x[1]))
    # near duplicates: one of each class of similar texts stays
    before = rows(out["language"])
    classes = Counter(c if c is not None else ("none", t) for (d, t), (_, c, _) in zip(before, brute_classes(before)))
    after = rows(out["near_duplicates"])
    assert not Counter(after) - Counter(before)
    assert len(after) >= len(classes)
    kept = brute_classes(after)
    assert all(n == 0 for _, _, n in kept) or len(kept) == len(classes)
    # passages: what stays is untouched or lost words only
    source = Counter(rows(out["near_duplicates"]))
    for d, t in rows(out["passages"]):
        assert source[d, t] or any(e == d and len(words(x)) > len(words(t)) for e, x in source)
    # benchmark: no window of 10 item words is left, and nothing else went
    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(x) for x in windows}
    bad = lambda t: any(tuple(w[i:i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    assert Counter(rows(out["benchmark"])) == Counter(x for x in rows(out["passages"]) if not bad(x[1]))
    # mix: readings in order, at most twice, near the targets
    mix = out["mix"].collect()
    sizes = {(r["doc_id"], r["text"]): len((r["text"] or "").split()) for r in out["benchmark"].collect()}
    taken = Counter()
    for r in mix:
        taken[r["doc_id"], r["text"]] += r["tokens"]
        assert 0 < r["tokens"] <= r["size"]
    assert all(n <= 2 * Counter(rows(out["benchmark"]))[k] * max(sizes[k], r_size(mix, k)) for k, n in taken.items())
    return out


def r_size(mix, key):
    return max(r["size"] for r in mix if (r["doc_id"], r["text"]) == key)


def test_pipeline_on_the_test_tables(spark, tmp_path):
    out = check(spark, SF_SMOKE, tmp_path)
    for name in ("language", "near_duplicates", "passages", "benchmark"):
        assert out[name].columns == out["in"].columns
    assert out["in"].count() > out["benchmark"].count() > 0


def test_pipeline_on_awkward_rows(spark, tables, tmp_path):
    check(spark, tables("awkward"), tmp_path)


def test_language_stage_rejects_strings_of_letters(spark):
    """Random letters go, whatever language they are labelled as; every other
    text with a letter stays, also one with a few such strings in it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(9)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 12)))) for _ in range(n))
    first = docs.where("lang = 'en' and length(text) > 500").orderBy("doc_id").first()["text"]
    added = [(-1 - i, noise(n), "en" if i % 2 else None) for i, n in enumerate([5, 40, 400, 2000])] + [(-10, first[:300] + " " + noise(5), "en")]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(added, docs.schema)), "").select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == clean | {-10}


def test_run_on_empty_tables(spark, tables):
    assert QUERIES["pipeline"](spark, tables("empty")).count() == 0
