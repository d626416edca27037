"""Small tables with every awkward row the operators must survive."""

import os
import random

import pytest

WORDS = ("the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
         "bridge river stone winter garden letter market window mountain village doctor teacher silver copper forest island").split()
LANGS = {"en": WORDS, "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus brücke fluss stein".split()}


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "ing", "ed", "s"]) for _ in range(n))


def awkward_documents():
    """(doc_id, text, lang, source, n_chars) with NULLs in every column, empty
    and long texts, ties, repeated rows, copies, near copies and passages."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    passage = sentence(rng, 70)
    near = base.split()
    near[150] = "changed"
    texts = {
        1: base, 2: base, 3: base.upper(), 4: " ".join(near), 5: None, 6: "", 7: " \n\t ", 8: "123 456 !!", 9: "one", 10: "one two three four",
        11: sentence(rng, 80) + "\n" + passage + "\n" + sentence(rng, 80), 12: sentence(rng, 90) + " " + passage + " " + sentence(rng, 60),
        13: passage, 14: "Licensed under CC BY-NC 4.0. cc by cc by\nAll Rights Reserved.", 15: "GNU General Public License, version 3 " + sentence(rng, 30),
        16: sentence(rng, 30_000), 17: "été über ñandú — “quoted” 東京 и так", 18: "— … “”", 19: sentence(rng, 40, LANGS["de"]), 20: sentence(rng, 60, LANGS["de"]),
        21: "a\x0bb\x0cc\x1cd e", 22: "This work is licensed under the GNU General Public License, version 3.",
        23: "Released under the new MIT License", 24: "one two three four", 25: "bench " + sentence(rng, 6),
    }
    rows = [(i, t, None if i % 7 == 0 else ("de" if i in (19, 20) else "en"), None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    rows += [(30 + i, sentence(rng, 60, LANGS["de" if i % 3 else "en"]), "de" if i % 3 else "en", "hot", 100) for i in range(60)]
    rows += [(1, base, "en", "s1", len(base)), (1, "another text under the same id " + sentence(rng, 20), "en", "s1", 5), (None, "no id " + sentence(rng, 30), "en", None, None),
             (None, None, None, None, None)]
    return rows, base, passage


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """folder(name): small tables as Parquet; "awkward" with extra columns of
    clashing names, "empty" without rows."""
    from pyspark.sql import functions as F

    made = {}

    def build(name):
        d = str(tmp_path_factory.mktemp(name))
        rows, base, _ = awkward_documents()
        few = (lambda x: x) if name == "awkward" else (lambda x: [])
        docs = spark.createDataFrame(few(rows), "doc_id long, text string, lang string, source string, n_chars long")
        for c in ("t", "size", "score", "position", "node", "seed", "label", "rank", "n_words", "tokens", "held_out", "lang_pred"):
            docs = docs.withColumn(c, F.lit("clash"))
        docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
        bench = [(1, " ".join(base.split()[20:45])), (2, "one two three four"), (3, None), (4, ""), (5, "nothing like this is anywhere in the texts at all today"),
                 (None, " ".join(base.split()[100:130])), (1, "one"), (6, sentence(random.Random(8), 30))]
        spark.createDataFrame(few(bench), "item_id long, text string").withColumn("term", F.lit("clash")).write.parquet(f"{d}/benchmark.parquet")
        labels = [(30 + i, i % 4 != 0 and 1 or 0, 0) for i in range(40)] + [(30, 1, 0), (None, 1, 0), (31, None, None)]
        spark.createDataFrame(few([(a, b, c) for a, b, c in labels]), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        urls = [(1, "http://a.example.net/en/1", '<a href="http://b.example.com/x">'), (2, "HTTPS://B.Example.COM/de/?q", '<a href="//c.example.org/">'), (3, None, None), (4, "no scheme", ""),
                (5, "http://x.org/fr/#f", None), (6, "http://x.org/en/", "<a href='http://bad.net'>"), (7, "http://bad.net", "x"), (7, "http://bad.net/en/", "x"), (8, "http://bad.net?x=://y/z", "y"),
                (9, "http://sub.b.example.com/en/1", '<a href="http://bad.net/">'), (10, "://", ""), (None, "http://u@h:80/p\n/q?r", None), (11, "http://net/", ""), (12, "http://c.example.org/fr/1", "")] * 2
        spark.createDataFrame(few(urls), "page_id long, url string, html string").withColumn("host", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
        rng = random.Random(3)
        vec = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)]
        vec += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(100)]
        vec += [(500, None, 1), (520, [], 1), (540, [0.0] * 8, 1), (560, [float("nan")] + [1.0] * 7, 1), (580, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (600, [1.0, 2.0], 1), vec[0]]
        spark.createDataFrame(few(vec), "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash")).write.parquet(f"{d}/embeddings.parquet")
        return d

    def folder(name):
        if name not in made:
            made[name] = build(name)
        return made[name]
    return folder


def read(folder, name):
    import pyarrow.parquet as pq
    return pq.read_table(os.path.join(folder, f"{name}.parquet")).to_pylist()
