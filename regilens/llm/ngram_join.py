"""Join of texts whose word 5-gram sets have a Jaccard similarity of 0.8 or more.

1. Texts with the same words are one class (grouped by a 64-bit hash of the
   word sequence, combined on the map side), so copies never meet in pairs.
2. A class has a MinHash signature for each of ``trees`` prefix tries. The
   matched prefix starts at ``depth`` values and is shortened until pairs at
   the threshold meet in some trie with probability ``recall`` (0.9997 by the
   defaults, prefix 5); classes under one trie node share its hash.
3. Every node names its smallest class the leader. Two classes that share a
   node share its leader, so all candidate pairs lie within the leaders' stars,
   and a class has at most one star per trie.
4. A star is cut into blocks of bounded shingle volume, and pairs of blocks are
   verified exactly in tasks, by products of shingle incidence matrices. A pair
   counts in its smallest common star only. What comes out is a number of
   links and a tree of edges per block pair; pairs of texts are never rows.
5. Classes of a connected component share the smallest doc_id as class id.

Edge cases: NULL, empty and wordless texts link to nothing and are classes of
their own; texts of 1 to 4 words have one shingle, all their words; a NULL
doc_id takes part, but gives no class id unless it is alone (NULL then); rows
that repeat a doc_id are documents of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, marked_texts, skewed_join, staged, table, text_key
from ._text import WORDS, Words, chunks, kgrams, list_array, mix, runs

TREES = 20
DEPTH = 8
BLOCK_SHINGLES = 1 << 19


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = 0.999) -> int:
    """The longest prefix at which pairs at the threshold meet often enough."""
    k = depth
    while k > 1 and 1 - (1 - threshold ** k) ** trees < recall:
        k -= 1
    return k


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all word n-grams, by text; a shorter text has one."""
    at, h = kgrams(w.hash, w.doc, n)
    doc = w.doc[at]
    size = w.counts()
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _weights(w), dtype=np.uint64)])
        one = total[w.first[short + 1]] - total[w.first[short]]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(one + size[short].astype(np.uint64))])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def _weights(w: Words) -> np.ndarray:
    return mix(w.index_in_doc().astype(np.uint64) + np.uint64(77)) | np.uint64(1)


def signatures(docs: DataFrame, n: int, trees: int, prefix: int) -> DataFrame:
    """(doc_id, t, node, shingles, nodes): node is the word sequence's hash
    (NULL without words), nodes the hash of the trie node in every tree."""
    keys = mix(np.arange(1000, 1000 + trees * prefix, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                full = np.flatnonzero(w.counts())
                seq = np.add.reduceat(w.hash * _weights(w), w.first[full]) if len(full) else np.zeros(0, np.uint64)
                seq = mix(seq + w.counts()[full].astype(np.uint64))
                doc, h = shingles(w, n)
                start = np.searchsorted(doc, full)
                nodes = np.zeros((len(full), trees), np.uint64)
                for t in range(trees if len(full) else 0):
                    for p in range(prefix):
                        low = np.minimum.reduceat(h * keys[t * prefix + p], start)
                        nodes[:, t] = mix(nodes[:, t] + low + np.uint64(t + 1))
                has = w.counts() > 0
                node = np.zeros(w.n_docs, np.uint64)
                node[full] = seq
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(node.view(np.int64), mask=~has), pa.array(np.bincount(doc, minlength=w.n_docs).astype(np.int64)),
                     list_array(nodes.ravel().view(np.int64), np.where(has, trees, 0), pa.int64())], ["doc_id", "t", "node", "shingles", "nodes"])
    return docs.select("doc_id", text_key(F.col("text")).alias("t"), "text") \
        .mapInArrow(run, "doc_id long, t long, node long, shingles long, nodes array<long>")


def linked(side: np.ndarray, sets: list[np.ndarray], size: np.ndarray, leaders: list[np.ndarray], leader: int, threshold: float):
    """Of two blocks of a star (side 0 and 1; side 2 is a block with itself):
    similar pairs as a matrix of side 0 rows by side 1 columns, and which of
    them count in this star. Two blocks of which one is empty have no pairs."""
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    b = a if (side == 2).all() else b

    def shared(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.float32)
        values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        if not len(values):
            return out
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(values, kind="stable")
        v, of = values[order], of[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        row = np.cumsum(new) - 1
        many = np.bincount(row)[row] > 1  # a value of one text only can't be shared
        of, row = of[many], np.unique(row[many], return_inverse=True)[1]
        step = 4096
        for r in range(0, int(row.max()) + 1 if len(row) else 0, step):
            i, j = np.searchsorted(row, [r, r + step])
            x = np.zeros((min(step, int(row.max()) + 1 - r), len(lists)), np.float32)
            x[row[i:j] - r, of[i:j]] = 1
            out += x[:, a].T @ x[:, b]
        return out

    both = shared(sets)
    similar = both * (1 + threshold) >= threshold * (size[a][:, None] + size[b][None, :]) - 1e-6
    if b is a:
        np.fill_diagonal(similar, False)
    earlier = shared([x[x < leader] for x in leaders]) > 0 if similar.any() else np.zeros_like(similar)
    return a, b, similar, similar & ~earlier


def _labels(a: np.ndarray, b: np.ndarray, similar: np.ndarray, n: int) -> np.ndarray:
    """For each row the smallest row index it is connected with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, np.where(similar, label[b][None, :], n).min(1, initial=n))
        np.minimum.at(new, b, np.where(similar, label[a][:, None], n).min(0, initial=n))
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, t (text key), class_id, n_links (the
    documents it is similar to, copies included) and stays (true for one row
    key per class)."""
    prefix = prefix_length(threshold, trees, depth, recall)
    sig = staged(signatures(docs, n, trees, prefix), "join-signatures")
    classes = staged(sig.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t")).alias("rep"), F.count("*").alias("copies"),
        F.max("shingles").alias("shingles"), F.first("nodes").alias("nodes")), "join-classes")
    met = staged(classes.select("node", F.explode("nodes").alias("trie")), "join-tries")
    heads = met.groupBy("trie").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    stars = staged(skewed_join(met, heads, "trie").select("leader", "node").distinct(), "join-stars")
    volume = classes.select("node", "shingles")
    blocks = stars.join(volume, "node").groupBy("leader").agg(F.sum("shingles").alias("volume"), F.count("*").alias("n")) \
        .select("leader", F.ceil(F.col("volume") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = skewed_join(stars, blocks, "leader").withColumn("own", F.pmod(F.xxhash64("node", "leader"), F.col("blocks")).cast("int"))
    units = dealt.select("node", "leader", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("node", "leader", F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
                F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    # a class is in at most one star per tree, in as many units as that star has blocks
    tasks = units.groupBy("node").agg(F.collect_list(F.struct("unit", "leader", "side")).alias("units"))
    own = stars.groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    asked = staged(tasks.join(own, "node").join(classes.select("node", "rep", "copies"), "node")
                   .select("node", "units", "leaders", "copies", F.col("rep.doc_id").alias("_d"), F.col("rep.t").alias("_t")), "join-members")
    texts = marked_texts(docs, asked, "_t", text_key(F.col("text"))) \
        .join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t"))).select("node", "copies", "leaders", "units", "text")

    def sets(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                doc, h = shingles(w, n)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(x)[i:j] for x in range(4)]
                                                 + [list_array(h[new].view(np.int64), np.bincount(doc[new], minlength=w.n_docs), pa.int64())],
                                                 ["node", "copies", "leaders", "units", "grams"])
    members = texts.mapInArrow(sets, "node long, copies long, leaders array<long>, units array<struct<unit: long, leader: long, side: int>>, grams array<long>") \
        .select(F.explode("units").alias("u"), "node", "copies", "leaders", "grams") \
        .select(F.col("u.unit").alias("unit"), F.col("u.leader").alias("leader"), F.col("u.side").alias("side"), "node", "copies", "leaders", "grams")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def verify(batches):
        for b in runs(batches):
            node, first = np.unique(b.column(3).to_numpy(), return_index=True)  # equal rows count once
            if len(node) < 2:
                continue
            copies = b.column(4).to_numpy()[first].astype(np.float64)
            cut = lambda k: [(c[o[x]:o[x + 1]]) for c, o in [_lists(b.column(k))] for x in first]
            grams = cut(6)
            side = b.column(2).to_numpy()[first]
            if not (side == 2).any() and len(np.unique(side)) < 2:
                continue  # the other block is empty
            a, c, similar, counted = linked(side, grams, np.array([len(x) for x in grams]), cut(5), b.column(1)[0].as_py(), threshold)
            links = np.zeros(len(node))
            np.add.at(links, a, counted @ copies[c])
            if c is not a:
                np.add.at(links, c, copies[a] @ counted)
            label = _labels(a, c, similar, len(node))
            told = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told].astype(np.int64)), pa.array(node[label[told]])], ["node", "links", "head"])
    checked = staged(members.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(verify, "node long, links long, head long"), "join-links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("node").alias("u"), F.col("head").alias("v")), "join")
    joined = classes.join(links, "node", "left").join(roots, "node", "left") \
        .select("node", "low", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    merged = joined.groupBy("root").agg(F.min("low").alias("class_id"), F.min("rep").alias("kept"))
    told = staged(joined.join(merged, "root").select("node", "class_id", "n_links", "kept"), "join-result")
    lone = sig.where("node is null").select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("stays"))
    return sig.where("node is not null").select("doc_id", "t", "node").join(told, "node") \
        .select("doc_id", "t", "class_id", "n_links", (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t"))).alias("stays")) \
        .unionByName(lone)


def _lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False), off


def op3_lsh_forest_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
