"""Benchmark decontamination with a distributed positional inverted index.

1. One pass counts, over all training texts, the terms of the test items.
2. Every window of ``width`` consecutive item words names its ``rare`` rarest
   terms (windows with a term that the training texts lack can't occur).
3. The index stores the postings (text, positions) of those terms over all
   texts; other terms' postings are never looked up and aren't stored.
4. Postings are joined to the items' terms and adjusted by their offset:
   entries of different terms that meet on the same start (text, item, start)
   are the intersection. Starts met by enough terms are candidates.
5. Candidates are compared with the texts word by word, which leaves exactly
   the places where a window occurs; ``proximity`` keeps loose ones instead.

Test terms reach the tasks as a bitmap of 1 MB whatever the number of items
(exact joins follow); items, postings and candidates are joined as tables, and
a hot term's postings are split by the skew join. Nothing is capped.

Edge cases: a NULL or empty text has no words and is clean; items without words
have no window; a NULL item_id marks words but can't be listed; rows that
repeat an item_id count once; rows that repeat a doc_id are told apart by their
text; an empty benchmark leaves every document clean; empty documents give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import hash_bitmap, marked, marked_texts, staged, table, text_key
from ._text import WORDS, chunks, list_array, lists, signed

WIDTH = 10
RARE = 3


def test_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): distinct items with their word hashes."""
    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], list_array(signed(w.hash), w.counts(), pa.int64())], ["item", "item_id", "words"])
    named = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text")
    return staged(named.mapInArrow(run, "item long, item_id string, words array<long>").where("size(words) > 0")
                  .dropDuplicates(["item", "item_id"]), "leak-items")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n) of the items' terms over all texts."""
    bitmap = hash_bitmap(items.select(F.explode("words").alias("term")), "term")

    def run(batches):
        for b in batches:
            for _, _, w in chunks(b, "text", WORDS):
                term, n = np.unique(w.hash[marked(bitmap.value, w.hash)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(n.astype(np.int64))], ["term", "n"])
    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def rare_terms(items: DataFrame, counts: DataFrame, width: int = WIDTH, rare: int = RARE) -> DataFrame:
    """(item, off, term): the rarest terms of every window that can occur."""
    terms = items.select("item", F.posexplode("words").alias("off", "term"))
    known = terms.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(
        F.struct("off", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("t")) \
        .select("item", F.col("t.term").alias("terms"), F.col("t.n").alias("ns"))  # one item's words

    def run(batches):
        for b in batches:
            (term, off), (n, _) = lists(b, "terms"), lists(b, "ns")
            item, at, hashes = [], [], []
            for r, name in enumerate(b.column(0).to_pylist()):
                t, c = term[off[r]:off[r + 1]], n[off[r]:off[r + 1]]
                size = min(width, len(t))
                picked = set()
                for s in range(len(t) - size + 1):
                    if c[s:s + size].min() > 0:
                        picked.update(s + x for x in np.argsort(c[s:s + size], kind="stable")[:rare].tolist())
                item += [name] * len(picked)
                at += sorted(picked)
                hashes += [int(t[x]) for x in sorted(picked)]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64())], ["item", "off", "term"])
    return staged(known.mapInArrow(run, "item long, off int, term long"), "leak-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: per text its key, number of words, and the postings
    (terms, positions) of the wanted terms."""
    bitmap = hash_bitmap(terms, "term")

    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                hit = np.flatnonzero(marked(bitmap.value, w.hash))
                per = np.bincount(w.doc[hit], minlength=w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(w.counts().astype(np.int64)), list_array(signed(w.hash[hit]), per, pa.int64()),
                     list_array(w.index_in_doc()[hit].astype(np.int32), per, pa.int32())], ["doc_id", "t", "n_words", "terms", "positions"])
    return staged(docs.select("doc_id", text_key(F.col("text")).alias("t"), "text").mapInArrow(
        run, "doc_id long, t long, n_words long, terms array<long>, positions array<int>"), "leak-index")


def adjusted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, t, item, off, start): postings moved to where their item would start."""
    postings = index.where("size(terms) > 0").select("doc_id", "t", F.explode(F.arrays_zip("terms", "positions")).alias("p")) \
        .select("doc_id", "t", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos"))
    return postings.join(terms, "term").select("doc_id", "t", "item", "off", (F.col("pos") - F.col("off")).alias("start"))


def exact_matches(docs: DataFrame, items: DataFrame, terms: DataFrame, index: DataFrame,
                  width: int = WIDTH, rare: int = RARE) -> DataFrame:
    """(doc_id, t, n_hit, items): the words inside an occurring window and the
    ids of the items with one, for every text that has any."""
    met = adjusted(index, terms).groupBy("doc_id", "t", "item", "start").agg(F.count("*").alias("met"))
    need = F.least(F.lit(rare), F.size("words"))
    found = staged(met.join(items, "item").where(F.col("met") >= need).select("doc_id", "t", "item_id", "start", "words"), "leak-candidates")
    per_doc = found.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(
                                                                                  F.collect_list(F.struct("item_id", "start", "words")).alias("c"))
    per_doc = staged(per_doc.select("_d", "_t", "c"), "leak-by-text")
    joined = marked_texts(docs, per_doc, "_t", text_key(F.col("text"))) \
        .join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t"))).select("doc_id", F.col("key").alias("t"), "text", "c")

    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                hits, names = [], []
                for r, cands in enumerate(b.column(3)[i:j].to_pylist()):
                    own = signed(w.hash[w.first[r]:w.first[r + 1]])
                    hit, ids = np.zeros(len(own) + 1, np.int64), set()
                    for c in cands:
                        words, start = np.asarray(c["words"], np.int64), c["start"]
                        size = min(width, len(words))
                        lo, hi = max(0, -start), min(len(words), len(own) - start)
                        if hi - lo < size:
                            continue
                        same = np.concatenate([[0], (own[start + lo:start + hi] == words[lo:hi]).astype(np.int64)]).cumsum()
                        whole = np.flatnonzero(same[size:] - same[:-size] == size)
                        if len(whole):
                            np.add.at(hit, start + lo + whole, 1)
                            np.add.at(hit, start + lo + whole + size, -1)
                            ids.add(c["item_id"])
                    hits.append(int((hit.cumsum() > 0).sum()))
                    names.append(sorted(x for x in ids if x is not None))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))],
                                                 ["doc_id", "t", "n_hit", "items"])
    return joined.mapInArrow(run, "doc_id long, t long, n_hit long, items array<string>").where("n_hit > 0").dropDuplicates(["doc_id", "t"])


def proximity(index: DataFrame, items: DataFrame, terms: DataFrame, slop: int = 3, share: float = 0.8) -> DataFrame:
    """(doc_id, t, item_id, first, met, wanted): texts where at least ``share``
    of an item's rarest terms stand within ``slop`` words of their place,
    relative to each other, whatever lies between them."""
    by = W.partitionBy("doc_id", "t", "item").orderBy("start")
    near = adjusted(index, terms).withColumn("_new", F.coalesce((F.col("start") - F.lag("start").over(by)) > slop, F.lit(True)).cast("int")) \
        .withColumn("_g", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))) \
        .groupBy("doc_id", "t", "item", "_g").agg(F.size(F.collect_set("off")).alias("met"), F.min("start").alias("first"))
    wanted = terms.groupBy("item").agg(F.count("*").alias("wanted")).join(items.select("item", "item_id"), "item")
    return near.join(wanted, "item").where(F.col("met") >= F.col("wanted") * share).select("doc_id", "t", "item_id", "first", "met", "wanted")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, rare: int = RARE) -> DataFrame:
    """One row per document: doc_id, t (text key), n_words, n_hit, items."""
    items = test_items(benchmark)
    terms = rare_terms(items, term_counts(docs, items), width, rare)
    index = build_index(docs, terms)
    hits = exact_matches(docs, items, terms, index, width, rare).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "n_hit", "items")
    return index.select("doc_id", "t", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left") \
        .select("doc_id", "t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op9_positional_index(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS MATERIALIZED (
  SELECT k, s, n, array_to_string(w[s + 1 : s + n], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT DISTINCT dw.k, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM m) GROUP BY k),
i AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN i USING (k)
"""
