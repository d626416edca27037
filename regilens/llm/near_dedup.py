"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

1. Texts with the same words are one class (grouped on the map side by a hash of
   the word sequence). A class has ``BANDS`` x ``ROWS`` MinHash values; classes
   with equal values in a band share a bucket.
2. Candidates are compared by their signatures, one batch of values after the
   other. After m agreements of n, with every similarity equally likely before,
   the similarity has a Beta(m + 1, n - m + 1) posterior; a pair goes as soon as
   the posterior gives the threshold or more less than ``miss``.
3. Pairs that survive all batches are confirmed on the full shingle sets, which
   are sent to their star's block: the star's centre once, then its partners
   one by one.
4. A component needs no more than a tree of links, so a bucket isn't paired all
   with all: in each of at most ``ROUNDS`` rounds every bucket names a member, by
   a random order that all buckets share, and all others of another component are
   compared with it; it is settled then and leaves the bucket. A group of near
   copies is one component after a round or two; no further round is made once
   the buckets hold no more than ``FEW_PAIRS`` pairs. Each round's links join the
   components of the rounds before. Of the buckets that still hold
   several components (as pages of one template, less alike than the threshold),
   the pairs across components are compared by signature and confirmed within
   tasks, in blocks of bounded size. So every candidate pair is either inside a
   component already or has been compared.

A link at the threshold shares no bucket with probability 4e-7 and is pruned
with a probability of some ``miss``; more similar ones less often still.

Edge cases: NULL, empty and blank texts have no shingles, link to nothing and
are their own component; texts of 1 to 4 words have one shingle; a NULL doc_id
takes part but names no component (NULL if it is alone, and kept); rows that
repeat a doc_id are documents of their own, and kept if the component bears
their id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, hash_bitmap, marked, skewed_join, staged, table, text_key
from ._text import TOKENS, Words, chunks, in_sorted, kgrams, list_array, mix, runs

SHINGLE = 5
BANDS = 25
ROWS = 5
BATCH = 25
ROUNDS = 2
MISS = 1e-6
FEW_PAIRS = 1 << 25
ASKED_BITS = 25
STAR_NODES = 2048
STAR_SHINGLES = 1 << 19


@lru_cache(maxsize=64)
def least_agreements(n: int, threshold: float, miss: float) -> int:
    """The fewest agreements of n values that leave the similarity a chance of
    ``miss`` to reach the threshold. The tail of the Beta posterior is the
    binomial chance of at most m successes in n + 1 trials."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(sig: np.ndarray, other: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Which of the pairs (row p of ``sig``, row q of ``other``) pass every batch."""
    alive, agree = np.arange(len(p)), np.zeros(len(p), np.int64)
    for k in range(0, sig.shape[1], batch):
        agree[alive] += (sig[p[alive], k:k + batch] == other[q[alive], k:k + batch]).sum(1)
        alive = alive[agree[alive] >= least_agreements(min(k + batch, sig.shape[1]), threshold, miss)]
    return alive


def shingle_sets(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct word n-grams, by text and hash; a text of
    fewer words has one for all of them."""
    at, h = kgrams(w.hash, w.doc, n)
    doc, size = w.doc[at], w.counts()
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        doc, h = np.concatenate([doc, short]), np.concatenate([h, sequence_hash(w)[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def sequence_hash(w: Words) -> np.ndarray:
    """Per text a hash of all its words in order."""
    weight = mix(w.index_in_doc().astype(np.uint64) + np.uint64(1234567)) | np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * weight, dtype=np.uint64)])
    return mix(total[w.first[1:]] - total[w.first[:-1]] + w.counts().astype(np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, node, n, sig): node is the word sequence's hash (NULL without
    words), n the number of distinct shingles, sig the MinHash values."""
    values = BANDS * ROWS
    keys = mix(np.arange(5000, 5000 + values, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", TOKENS):
                doc, h = shingle_sets(w)
                has = w.counts() > 0
                full = np.flatnonzero(has)
                start = np.searchsorted(doc, full)
                sig = np.zeros((len(full), values), np.int32)
                for k in range(values if len(full) else 0):
                    sig[:, k] = (np.minimum.reduceat(h * keys[k], start) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(sequence_hash(w).view(np.int64), mask=~has), pa.array(np.bincount(doc, minlength=w.n_docs).astype(np.int64)),
                     list_array(sig.ravel(), np.where(has, values, 0), pa.int32())], ["doc_id", "t", "node", "n", "sig"])
    return docs.select("doc_id", text_key(F.col("text")).alias("t"), "text").mapInArrow(run, "doc_id long, t long, node long, n long, sig array<int>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _alike(n: str, m: str, percent: int):
    """Sets of such different sizes can't be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def pruned(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = skewed_join(skewed_join(pairs, two, "b"), one, "a").where(_alike("na", "nb", percent)).select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            if b.num_rows:
                each = np.arange(b.num_rows)
                keep = survivors(_rows(b.column(2)), _rows(b.column(3)), each, each, percent / 100, miss)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])
    return both.mapInArrow(run, "a long, b long")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, grams): the shingle sets of the classes asked for."""
    asked = staged(nodes.distinct().join(classes.select("node", F.xxhash64("rep.doc_id", "rep.t").alias("asked")), "node"), "dedup-asked")
    bitmap = hash_bitmap(asked, "asked", ASKED_BITS)  # lets few others through; the join below is exact

    def sets(batches):
        for b in batches:
            b = b.filter(pa.array(marked(bitmap.value, b.column(0).to_numpy().view(np.uint64), ASKED_BITS)))
            for i, j, w in chunks(b, "text", TOKENS):
                doc, h = shingle_sets(w)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], list_array(h.view(np.int64), np.bincount(doc, minlength=w.n_docs), pa.int64())], ["key", "grams"])
    read = docs.select(F.xxhash64(F.col("doc_id"), text_key(F.col("text"))).alias("key"), "text")
    # a row that is repeated gives its set as often: one each
    each = read.mapInArrow(sets, "key long, grams array<long>").dropDuplicates(["key"])
    return staged(each.join(asked.hint("merge"), F.col("key") == F.col("asked")).select("node", "grams"), "dedup-sets")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def across(buckets: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between different components within buckets, enough to
    connect what is connected. Buckets that name the same member are one star; a
    star is cut into blocks, and a task meets two blocks: the pairs across
    components are pruned by signature, and what survives is confirmed on the
    full sets unless links found before join it already. Pairs are never rows."""
    named = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(-1)).alias("o"), "node")).alias("c")).select("bucket", F.col("c.node").alias("star"))
    stars = staged(skewed_join(buckets, named, "bucket").select("star", "node", "root").distinct(), "dedup-across")
    full = full_sets(stars.select("node"), classes, docs)
    sizes = stars.join(classes.select("node", "n"), "node").groupBy("star").agg(
        F.ceil(F.greatest(F.sum("n") / STAR_SHINGLES, F.count("*") / STAR_NODES)).cast("int").alias("blocks"))
    dealt = skewed_join(stars, sizes, "star").withColumn("own", F.pmod(F.xxhash64("node", "star"), F.col("blocks")).cast("int"))
    units = dealt.select("star", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select(F.xxhash64("star", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.when(F.col("own") == F.col("other"), 2)
                .otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "node", "root")
    parts = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = skewed_join(skewed_join(units, classes.select("node", "n", "sig"), "node"), full, "node").select("unit", "side", "node", "root", "n", "sig", "grams")

    def run(batches):
        for b in runs(batches):
            side, node, root, n, sig = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), _rows(b.column(5))
            column = b.column(6)
            off = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)
            one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: the block with itself
            roots, group = np.unique(root, return_inverse=True)
            parent, group = list(range(len(roots))), group.tolist()  # of each row its component, by number
            found = []
            step = max(1, (1 << 16) // max(1, len(two)))
            for i in range(0, len(one), step):
                x = one[i:i + step]
                open_ = (root[x][:, None] != root[two][None, :]) & (100 * np.minimum(n[x][:, None], n[two][None, :]) >= percent * np.maximum(n[x][:, None], n[two][None, :]))
                if (side == 2).any():
                    open_ &= node[x][:, None] < node[two][None, :]
                p, q = np.nonzero(open_)
                p, q = x[p], two[q]
                keep = survivors(sig, sig, p, q, percent / 100, miss)
                p, q = p[keep], q[keep]
                for k in np.unique(p).tolist():
                    mine = _find(parent, group[k])
                    ask = [y for y in q[p == k].tolist() if _find(parent, group[y]) != mine]
                    if not ask:
                        continue
                    held = flat[off[k]:off[k + 1]]  # in the order of unsigned values
                    hit, _ = in_sorted(held.view(np.uint64), np.concatenate([flat[off[y]:off[y + 1]] for y in ask]).view(np.uint64))
                    size = n[ask]
                    ends = np.concatenate([[0], np.cumsum(size)])
                    both = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])
                    for y in np.flatnonzero(100 * both >= percent * (len(held) + size - both)).tolist():
                        r, t = _find(parent, group[k]), _find(parent, group[ask[y]])
                        if r != t:
                            parent[r] = t
                            found.append((node[k], node[ask[y]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    return rows.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    full = full_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), classes, docs)
    volume = pairs.join(classes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.sum("n") / STAR_SHINGLES).cast("int").alias("blocks"))
    volume = staged(volume, "dedup-stars")
    members = skewed_join(pairs, volume, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("b").alias("node"))
    centres = volume.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("node"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = skewed_join(centres.unionByName(members), full, "node").select("a", "block", "role", "node", "grams")

    def check(batches):
        centre, held = None, np.zeros(0, np.int64)
        for b in batches:
            a, role, node = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            column = b.column(4)
            off = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(role == 0), np.flatnonzero(role == 0) + 1, [len(a)]])).tolist()
            for i, j in zip(cuts, cuts[1:]):
                if role[i] == 0:  # rows of a block follow its centre
                    centre, held = a[i], np.sort(flat[off[i]:off[i + 1]])
                    continue
                found, _ = in_sorted(held, flat[off[i]:off[j]])
                total = np.concatenate([[0], np.cumsum(found)])
                both = np.diff(total[off[i:j + 1] - off[i]])
                size = np.diff(off[i:j + 1])
                good = np.flatnonzero(100 * both >= percent * (len(held) + size - both))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), centre)), pa.array(node[i:j][good])], ["a", "b"])
    return rows.repartition(parts, "a", "block").sortWithinPartitions("a", "block", "role").mapInArrow(check, "a long, b long")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of all links so far: the components ``roots``
    (none before the first links) joined by the new links (a, b)."""
    if roots is None:
        return staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "dedup"), "dedup-roots")
    of = lambda end, name: roots.select(F.col("node").alias(end), F.col("root").alias(name))
    between = links.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left") \
        .select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v"))
    joined = staged(components(between, "dedup"), "dedup-joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return staged(moved.unionByName(joined.join(roots, "node", "left_anti")), "dedup-roots")


def bucket_pairs(buckets: DataFrame) -> int:
    """The pairs of members, over all buckets."""
    k = F.col("k").cast("decimal(38,0)")
    return int(buckets.groupBy("bucket").agg(F.count("*").alias("k")).agg(F.sum(k * (k - 1))).first()[0] or 0) // 2


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = MISS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, t (text key), n_shingles, component_id, kept."""
    sig = staged(signatures(docs), "dedup-signatures")
    classes = staged(sig.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t")).alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig")), "dedup-classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * ROWS + 1, F.lit(ROWS))))
    banded = staged(classes.select("node", F.explode(bands).alias("bucket")), "dedup-bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    buckets = staged(skewed_join(banded, shared, "bucket").select("bucket", "node", F.col("node").alias("root")), "dedup-buckets")
    roots, r, last = None, 0, rounds == 0
    while True:
        if last:
            found = across(buckets, classes, docs, percent, miss)
        else:
            centre = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("o"), "node", "root")).alias("c")) \
                .select("bucket", F.col("c.node").alias("centre"), F.col("c.root").alias("its_root"))
            led = staged(skewed_join(buckets, centre, "bucket").where("node <> centre"), "dedup-led")
            tried = pruned(led.where("root <> its_root").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), classes, percent, miss)
            found = confirmed(staged(tried, "dedup-pairs"), classes, docs, percent)
        roots = merged(roots, staged(found, "dedup-links"))
        if last:
            break
        # buckets that still hold several components
        moved = skewed_join(led.select("bucket", "node"), roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        moved = staged(moved, "dedup-moved")
        several = moved.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        buckets = staged(skewed_join(moved, several, "bucket"), "dedup-buckets")
        r += 1
        last = r == rounds or bucket_pairs(buckets) <= FEW_PAIRS
    named = classes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    told = staged(named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id"), "dedup-result")
    out = sig.where("node is not null").select("doc_id", "t", "node", "n").join(told, "node").select("doc_id", "t", "n", "component_id") \
        .unionByName(sig.where("node is null").select("doc_id", "t", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_bayesian_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
uniq AS (SELECT w, row_number() OVER () AS u, low FROM (SELECT w, min(doc_id) AS low FROM d WHERE len(w) > 0 GROUP BY w)),
grams AS (
  SELECT DISTINCT u, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g
  FROM uniq),
sizes AS (SELECT u, count(*) AS n FROM grams GROUP BY u),
shared AS (SELECT a.u AS x, b.u AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.u < b.u GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.u = x JOIN sizes b ON b.u = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT u, u FROM uniq UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
lowest AS (SELECT x AS u, min(low) AS c FROM reach JOIN uniq ON uniq.u = reach.y GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN d.doc_id ELSE c END AS component_id,
  d.doc_id IS NOT DISTINCT FROM (CASE WHEN n IS NULL THEN d.doc_id ELSE c END) AS kept
FROM d LEFT JOIN uniq USING (w) LEFT JOIN sizes USING (u) LEFT JOIN lowest USING (u)
"""
