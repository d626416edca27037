"""Near duplicates, passages and neighbours against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from regilens.llm import curve_search, decontaminate, ngram_join, passages
from regilens.llm.queries import QUERIES

SF_SMOKE, SF_ORACLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_classes(texts):
    """(links, class) by row number: all pairs."""
    sets = {}
    for i, (_, x) in enumerate(texts):
        w = words(x)
        if w:
            sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    where, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            for j in where[g]:
                both[j, i] += 1
            where[g].append(i)
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, j), n in both.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, low.get(find(i)), links[i]) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("data", ["sf0.001", "awkward", "empty"])
def test_join_equals_all_pairs(spark, tables, data):
    folder = SF_SMOKE if data == "sf0.001" else tables(data)
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in QUERIES["op3_lsh_forest_join"](spark, folder).select("doc_id", "class_id", "n_links").collect())
    assert got == Counter(brute_classes(texts))


def test_join_of_a_hot_group_in_blocks(spark, monkeypatch):
    """Copies and near copies of one text, cut into many block pairs."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300 + i, " ".join(f"y{rng.randrange(500)}" for _ in range(80))) for i in range(30)]
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
                  .select("doc_id", "class_id", "n_links").collect())
    want = Counter(brute_classes(rows))
    assert sum((got - want).values()) <= 2  # a link at the threshold is found with probability 0.9997


def test_links_count_once_where_a_block_is_empty(spark, monkeypatch):
    """Two or three near copies whose star has more blocks than members."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(400)]
        for c in range(2 + g % 2):
            rows.append((10 * g + c, " ".join([*base[:200], f"c{c}", *base[200:]])))
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 150)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
                  .select("doc_id", "class_id", "n_links").collect())
    assert got == Counter(brute_classes(rows))


def covered(rows, min_words=50):
    """Words of each text inside a run of 50 words that a smaller doc_id has."""
    first, out = {}, {}
    for d, x in sorted(rows):
        w = words(x)
        hit, own = np.zeros(len(w), bool), set()
        for k in range(len(w) - min_words + 1):
            g = tuple(w[k:k + min_words])
            if g in first:
                hit[k:k + min_words] = True
            else:
                own.add(g)
        for g in own:
            first.setdefault(g, d)
        out[d] = hit
    return out


def test_passages_cover_repeated_runs_and_spare_clean_texts(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, hot = text(64), text(55)
    fuzzy = text(120).split()
    broken = list(fuzzy)
    for k in range(15, 120, 30):
        broken[k] = "zz"
    del broken[60]
    rows = [(i, f"{text(40)}\n{passage} {text(rng.randrange(30, 90))}") for i in range(10)]
    rows += [(20 + i, f"{text(60)} {hot}\n{text(20)}") for i in range(60)]
    rows += [(100, text(50) + " " + " ".join(fuzzy)), (101, " ".join(broken) + " " + text(50)), (102, text(300)), (103, text(45) + " " + " ".join(passage.split()[:30]) + " " + text(45))]
    rows += [(110, rows[0][1]), (111, f"{text(20)} {text(60)}")]
    loop = text(60)
    rows += [(112, f"{loop} {text(10)} {loop}")]  # repeats within a document only
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
        assert r["source_id"] < r["doc_id"]
    want = covered(rows)
    for d, x in rows:
        missing = set(np.flatnonzero(want[d]).tolist()) - got[d]
        assert not missing, d
    assert {d for d in got if got[d]} == {d for d, _ in rows if want[d].any()} | {101}
    for d in (102, 103, 111, 112, 0, 20, 100):
        assert not got[d]
    assert all(len(got[d]) - want[d].sum() <= 6 for d in got if d != 101)
    assert 100 <= len(got[101]) <= 125


def test_runs_within_themselves_and_with_borrowed_seeds_are_found(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    run = text(50)
    parts = run.split()
    rows = [(i, f"{text(30)} {' '.join(parts[i:i + 30])} {text(30)}") for i in range(0, 21, 5)]  # its seeds first stand in texts of their own
    rows += [(30, f"{text(40)} {run} {text(40)}"), (31, f"{text(60)} {run} {text(20)}")]
    rows += [(40, f"{text(40)} {'la ' * 80}{text(40)}"), (41, f"{text(20)} {'la ' * 120}{text(30)}"), (42, f"{text(20)} {'la ' * 45}{text(30)}")]
    line = text(4)
    rows += [(50, f"{text(40)} {' '.join([line] * 20)} {text(40)}"), (51, f"{text(10)} {' '.join([line] * 30)} {text(40)}"), (None, f"{text(80)} {'do ' * 60}"), (60, f"{'do ' * 55}{text(20)}")]
    got = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    want = covered([(-1 if d is None else d, t) for d, t in rows])
    assert want[31].sum() >= 50 and want[41].sum() >= 80 and want[51].sum() >= 80 and want[60].sum() >= 55
    for d, _ in rows:
        assert not set(np.flatnonzero(want[-1 if d is None else d]).tolist()) - got[d], d
    assert not any(got[d] for d in (0, 5, 10, 15, 20, 40, 42, 50, None))


def test_short_lines_of_two_sources_are_no_passage(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b = text(40), text(40)
    rows = [(1, f"{text(30)} {a} {text(30)}"), (2, f"{text(30)} {b} {text(30)}"), (3, f"{text(20)} {a} {b} {text(20)}")]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    rows += [(4, f"{text(20)} {a} {b} {text(20)}")]
    (r,) = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert r["doc_id"] == 4 and r["end"] - r["start"] >= 80


def test_cut_removes_the_passages_and_keeps_other_texts(spark, tables):
    docs = spark.createDataFrame([(1, "Éa b, c d e. f", 9, "x"), (2, "a b c", 5, "y"), (3, None, None, None), (4, "", 0, "z"), (5, "same text", 9, "q")],
                                 "doc_id long, text string, n_chars int, __spans string")
    from pyspark.sql import functions as F
    cuts = docs.where("doc_id in (1, 2)").select("doc_id", F.shiftright(F.xxhash64("text"), 32).alias("tk"), F.lit(1).alias("start"), F.when(F.col("doc_id") == 1, 3).otherwise(9).alias("end"))
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in passages.cut_passages(docs.drop("__spans"), cuts).collect()}
    assert out == {1: ("Éa d e. f", 9), 2: ("a", 1), 3: (None, None), 4: ("", 0), 5: ("same text", 9)}


def test_passage_query_on_awkward_and_empty_tables(spark, tables):
    rows = QUERIES["op5_chained_passages"](spark, tables("awkward")).collect()
    docs = {r["doc_id"] for r in rows}
    assert {2, 3, 4, 12, 13} <= docs and not docs & {5, 6, 7, 8, 9, 10, 14, 16, 17, 18}
    assert QUERIES["op5_chained_passages"](spark, tables("empty")).count() == 0


def test_proximity_finds_loose_phrases(spark):
    docs = spark.createDataFrame([(1, "zeta so alpha then beta and gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha " + "x " * 30 + "beta gamma delta")], "doc_id long, text string")
    items = decontaminate.test_items(spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string"))
    terms = decontaminate.rare_terms(items, decontaminate.term_counts(docs, items), rare=4)
    index = decontaminate.build_index(docs, terms)
    near = {r["doc_id"] for r in decontaminate.proximity(index, items, terms, slop=2, share=1.0).collect()}
    assert near == {1, 2}


def nearest(rows, k=20):
    seen, ids, vs = set(), [], []
    for i, v in rows:
        key = (i, tuple(v) if v else None)
        if i is None or not v or len(v) != 8 or not np.isfinite(v).all() or not np.any(v) or key in seen:
            continue
        seen.add(key)
        ids.append(i)
        vs.append(v)
    x, ids = np.array(vs, float), np.array(ids)
    out = {}
    for r in np.flatnonzero(ids % 20 == 0):
        s = (x * x[r]).sum(1)
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != ids[r]][:k]
        out[int(ids[r])] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_search_is_exact_when_the_window_covers_all(spark, tables):
    folder = tables("awkward")
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet")
    from pyspark.sql import functions as F
    got = defaultdict(list)
    for r in curve_search.search(vecs, F.col("vec_id") % 20 == 0, window=10_000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = nearest([(r["vec_id"], r["embedding"]) for r in vecs.collect()])
    assert set(got) == set(want)
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12), q
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q


def test_search_query_reaches_the_recall(spark, tables):
    rows = QUERIES["op7_hilbert_search"](spark, SF_SMOKE).collect()
    vecs = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMOKE}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in vecs], float), np.array([i for i, _ in vecs])
    hit = total = 0
    for r in np.flatnonzero(ids % 20 == 0):
        s = x @ x[r]
        s[r] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit += len(best & {y["vec_id"] for y in rows if y["query_id"] == ids[r]})
        total += 20
    assert hit / total >= 0.9
    assert QUERIES["op7_hilbert_search"](spark, tables("empty")).count() == 0
