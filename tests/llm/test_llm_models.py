"""Trained operators: exact base figures, held-out quality, defined edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from regilens.llm import langid, mixing, quality, suffix_lm
from regilens.llm.queries import QUERIES

SF_SMOKE, SF_ORACLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def test_language_of_held_out_texts(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op4_word_backoff"](spark, SF_SMOKE).collect()}
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d["doc_id"]]["held_out"] == (crc(d["doc_id"], 4) == 2) for d in docs)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"]]
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_edge_cases(spark, tables):
    rows = QUERIES["op4_word_backoff"](spark, tables("awkward")).collect()
    docs = spark.read.parquet(f"{tables('awkward')}/documents.parquet").collect()
    letter = lambda t: any(c.isalpha() for c in t or "")
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in rows) == Counter((d["doc_id"], not letter(d["text"])) for d in docs)
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert QUERIES["op4_word_backoff"](spark, tables("empty")).count() == 0
    blank = langid.learn(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert langid.predict(spark.createDataFrame([(1, "word")], "doc_id long, text string"), blank).collect()[0]["lang_pred"] == "und"


def test_unknown_words_back_off_to_shorter_grams(spark):
    model = langid.learn(spark.createDataFrame([("schlange schloss schrift", "de"), ("thing then thought", "en")], "text string, lang string"))
    out = langid.predict(spark.createDataFrame([(1, "schlaf"), (2, "thinker"), (3, "schqx"), (4, "qqth")], "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in out.orderBy("doc_id").collect()] == ["de", "en", "de", "en"]


def brute_votes(train, text):
    """Log frequency votes of a text of known words, from the counts."""
    count = {lang: Counter(w for t, x in train if x == lang for w in t.lower().split()) for lang in {x for _, x in train}}
    total = {lang: sum(c.values()) for lang, c in count.items()}
    share = lambda w: sum(c[w] for c in count.values()) / sum(total.values())
    docs = Counter(x for _, x in train)
    return {lang: math.log(docs[lang] / len(train)) + sum(math.log((c[w] + langid.PRIOR * share(w)) / (total[lang] + langid.PRIOR)) for w in text.lower().split())
            for lang, c in count.items()}


def test_a_tiny_language_gains_nothing_from_words_it_never_had(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("ar", "en", "il", "ou") for c in ("t", "man", "ler", "sing", "ow", "ed", "ish", "ment", "ful", "er")]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    large = [" ".join(rng.choice(vocabulary, 400, p=weight / weight.sum())) for _ in range(500)]
    tiny = [" ".join(rng.choice(["привет", "река", "зима", "камень", "сад", "мост", "рынок", "окно"], 20)) for _ in range(3)]
    train = [(t, "en") for t in large] + [(t, "ru") for t in tiny]
    model = langid.learn(spark.createDataFrame(train, "text string, lang string"))
    rare = [" ".join(rng.choice(vocabulary[-150:], 25)) for _ in range(10)] + [" ".join(rng.choice(vocabulary, 25)) for _ in range(5)]
    texts = rare + ["камень мост сад", "окно"]
    out = {r["i"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model, ("i",)).collect()}
    assert [out[i]["lang_pred"] for i in range(len(texts))] == ["en"] * len(rare) + ["ru"] * 2
    seen = {w for t, _ in train for w in t.split()}
    for i, t in enumerate(texts):
        if set(t.split()) <= seen:
            votes = brute_votes(train, t)
            want = 1 / sum(math.exp(v - max(votes.values())) for v in votes.values())
            assert out[i]["lang_pred"] == max(votes, key=votes.get) and abs(out[i]["score"] - want) < 1e-3


def test_a_small_language_keeps_its_words(spark):
    """Shares are per language: a word counts as known by its own language's size."""
    train = [("the house and the river " * 400, "en")] * 50 + [("das haus und der fluss", "de")] * 2
    model = langid.learn(spark.createDataFrame(train, "text string, lang string"), min_share=1e-3)
    out = langid.predict(spark.createDataFrame([(1, "haus und fluss"), (2, "house and river")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["de", "en"] and len(model["words"][0]) == 9


def test_fit_tells_texts_from_strings_of_letters(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.learn(docs.where(~held))
    rng = np.random.default_rng(9)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(n)) for n in (5, 50, 500)]
    strange = langid.predict(spark.createDataFrame(list(enumerate(noise)), "i int, text string"), model, ("i",), fit=True).collect()
    texts = langid.predict(docs.where(held), model, fit=True).where("lang_pred <> 'und'").collect()
    bound = {lang: max(math.log(1e4 / (n + 1e4)), -6) for lang, n in zip(model["langs"], model["size"][4])}
    assert len(strange) == 3 and all(bound[r["lang_pred"]] - 1e-5 <= r["fit"] < 0.75 * bound[r["lang_pred"]] for r in strange)
    assert len(texts) > 100 and all(-2 < r["fit"] <= 0 for r in texts)
    little = langid.learn(spark.createDataFrame([("a few words", "en")], "text string, lang string"))
    out = langid.predict(spark.createDataFrame([(0, noise[0]), (1, None), (2, "")], "i int, text string"), little, ("i",), fit=True)
    assert all(abs(r["fit"]) < 0.1 for r in out.collect())


def test_quality_of_held_out_texts(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op8_bradley_terry"](spark, SF_ORACLE).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    held = [d for d in labels if d in rows and rows[d]["held_out"]]
    assert all(rows[d]["held_out"] == (crc(d, 5) == 0) for d in rows)
    good, bad = [rows[d]["score"] for d in held if labels[d] == 1], [rows[d]["score"] for d in held if labels[d] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.95
    assert np.mean([rows[d]["predicted"] == labels[d] for d in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_quality_edge_cases(spark, tables):
    rows = QUERIES["op8_bradley_terry"](spark, tables("awkward")).collect()
    assert len(rows) == spark.read.parquet(f"{tables('awkward')}/documents.parquet").count()
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert QUERIES["op8_bradley_terry"](spark, tables("empty")).count() == 0
    weights, bias = quality.fit(np.zeros((3, len(quality.FEATURES))), np.ones(3))
    assert not weights.any() and bias == 0


def test_quality_sample_stays_small_and_counts_repeats_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda x, y, **more: (taken.append((len(x), y.mean())), (np.zeros(x.shape[1]), 0.0))[1])
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "array(double(id % 3 != 0), 2.0D) as x").repartition(8)
    labels = spark.range(60_000).selectExpr("id as doc_id", "int(id % 2) as quality")
    quality.learn(rows, labels, max_rows=500)
    quality.learn(rows.where("doc_id < 100"), labels, max_rows=500)
    assert [n for n, _ in taken] == [500, 66] and 0.4 < taken[0][1] < 0.6


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def check_base(spark, folder):
    rows = QUERIES["op6_suffix_tree"](spark, folder).collect()
    docs = [(r["doc_id"], tokens(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    c = Counter(x for d, t in docs if crc(d, 10) != 0 for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, crc(d, 10) == 0, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for d, t in docs)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9, atol=1e-5)
    return rows


def test_model_base_figures_and_gain(spark):
    rows = check_base(spark, SF_SMOKE)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_edge_cases(spark, tables):
    check_base(spark, tables("awkward"))
    assert QUERIES["op6_suffix_tree"](spark, tables("empty")).count() == 0
    none, model = suffix_lm.learn(spark.createDataFrame([], "text string"))
    out = suffix_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none, model).collect()[0]
    assert (out["n_tokens"], out["n_known"], out["train_tokens"], out["base_score"], out["score"]) == (3, 0, 0, 0.0, 0.0)


def brute_tree(texts, max_order, min_context, min_entry, min_kl):
    """P(token | context) by plain counting of all runs, and the kept contexts."""
    streams = [["<s>", *t.split(), "</s>"] for t in texts]
    runs = Counter(tuple(s[i:i + k]) for s in streams for k in range(1, max_order + 2) for i in range(len(s) - k + 1))
    unigrams = Counter({r[0]: n for r, n in runs.items() if len(r) == 1 and r != ("<s>",)})
    n, v = sum(unigrams.values()), len(unigrams)
    after = {}
    for r, c in runs.items():
        if len(r) > 1 and c >= min_entry and runs[r[:-1]] >= min_context:
            after.setdefault(r[:-1], {})[r[-1]] = c
    kept = {}

    def p(token, context):
        if not context:
            return (unigrams[token] + 0.1) / (n + 0.1 * (v + 1))
        low = p(token, context[1:])
        if context not in kept:
            return low
        whole, entries = runs[context], kept[context]
        free = len(entries) + whole - sum(entries.values())
        return (entries.get(token, 0) + free * low) / (whole + len(entries))

    for context in sorted(after, key=len):
        if len(context) > max_order:
            continue
        whole, entries = runs[context], after[context]
        low = {s: p(s, context[1:]) for s in entries}
        rest = 1 - sum(entries.values()) / whole
        kl = sum(c / whole * math.log(c / whole / low[s]) for s, c in entries.items())
        kl += rest * math.log(rest / max(1 - sum(low.values()), 1e-12)) if rest > 0 else 0
        if kl >= min_kl and 2 * whole * kl >= len(entries) + 4 * math.sqrt(2 * len(entries)):
            kept[context] = entries
    return p, kept, unigrams


def test_runs_are_counted_alike_in_any_number_of_shares(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, 60) % 40) for _ in range(80)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    every = spark.sparkContext.broadcast(np.full(1 << (suffix_lm.BITS - 3), 255, np.uint8))
    streams = [["<s>", *(t or "").split(), "</s>"] for t in texts]
    monkeypatch.setattr(suffix_lm, "HELD", 500)
    for order in (1, 3):
        plain = Counter(tuple(s[i:i + order + 1]) for s in streams for i in range(len(s) - order))
        for shares in (1, 2):
            got = [r for x in range(shares) for r in suffix_lm.next_counts(frame, order, every, every, 2, x, shares).collect()]
            assert len({r["g"] for r in got}) == len(got)
            assert sorted(r["n"] for r in got) == sorted(n for n in plain.values() if n >= 2)


def test_hashes_can_be_taken_back():
    a, b = np.random.default_rng(1).integers(0, 1 << 63, (2, 1000)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (suffix_lm.suffix(suffix_lm.longer(a, b), a) == b).all()


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time
    from pathlib import Path

    from regilens.llm._spark import staged
    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {str(f) for d in root for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    out = staged(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "left")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 700


def test_tree_scores_equal_plain_counting(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        t = [str(rng.choice(words))]
        for _ in range(int(rng.integers(0, 60))):
            t.append(words[(int(t[-1][1:]) * 7 + 3 * (len(t) > 1 and t[-2] < "w2")) % 30] if rng.random() < 0.6 else str(rng.choice(words)))
        texts.append(" ".join(t))
    texts += ["w1 w2 w3 w4 w5"] * 20 + ["", "w1"]
    p, kept, unigrams = brute_tree(texts, 3, 12, 3, 0.01)
    assert {len(c) for c in kept} == {1, 2, 3} and any(c[0] == "<s>" for c in kept)
    for context in sorted(kept)[::7]:  # all tokens and one never seen
        assert abs(sum(p(s, context) for s in unigrams) + p("never", context) - 1) < 1e-9
    tree, model = suffix_lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), 3, 12, 3)
    asked = [*texts, "w1 never w2 w3", "never", "w1  w2\tw3 w9"]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for share in (1e-6, 2e-3, 1.0):  # all runs in the tasks, some, none
        for r in suffix_lm.score(frame, tree, model, hot_share=share).collect():
            s = ["<s>", *asked[r["doc_id"]].split(), "</s>"]
            want = sum(math.log10(p(s[i], tuple(s[max(0, i - 3):i]))) for i in range(1, len(s)))
            assert abs(r["score"] - want) < 1e-6 and r["n_known"] == sum(unigrams[x] > 0 for x in s[1:])


def test_tree_grows_with_the_corpus(spark):
    """Twice the texts never lose a context; new text adds runs."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("text")
    small = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("text")
    size = lambda d: (lambda t: (t.count(), t.where("b = 0").count()))(suffix_lm.learn(d)[0])
    (keys, runs), (more_keys, more_runs) = size(small), size(docs)
    assert more_keys > 2 * keys and more_runs > 4 * runs > 0


def test_mix_targets_and_order(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    mixed = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixed.collect()
    by = Counter()
    for r in out:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(by[r["source"]] - r["target"]) <= 1 for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum(by.values()) - 1.5 * total) <= 10
    order = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    # a source whose weight falls over time is read earlier than one whose weight grows
    early = mixing.curriculum(spark.createDataFrame([(i, "w w", "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string"),
                              cycle=(1, 1), budget=1.0, schedule=((2.0, 0.0), (0.0, 2.0)))
    mean = {r["source"]: r["m"] for r in early.groupBy("source").agg(F.avg("position").alias("m")).collect()}
    assert mean["a"] < 0.4 < 0.6 < mean["b"]
