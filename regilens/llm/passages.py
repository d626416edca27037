"""Substring dedup: repeated passages found by chaining word seeds.

1. Every text is sampled by winnowing: of each ``window`` consecutive word
   ``k``-grams the one with the smallest hash is a seed, so any run of
   window + k - 1 equal words (23) shares a seed.
2. A seed's first place (smallest doc_id, combined on the map side) is its
   head. Seeds are joined to the heads, each other place meets the head only:
   matches grow with the text, whatever number of documents share a passage.
3. Matches of a (document, head document) pair are chained in order: the best
   chain that ends in a match gains k, pays ``GAP`` for each word skipped in
   either text, and its best predecessor is the maximum over a Fenwick tree.
4. Chains are aligned with the words of both texts: gaps are compared, both
   ends extended, chains split where the texts differ for long.
5. Runs of ``min_words`` equal words are found exactly besides. All but the
   ends of such a run is dense with seeds that some other document has too, so
   only those stretches are read: each of their runs of ``min_words`` words is
   a hash that meets its own first place, by groups of neighbours if it can. A run within itself (one word over and
   over) or with seeds that first stand elsewhere is found like any other.
6. Pieces of a document that touch are merged, first those of one source:
   they are repeated if they have ``min_words`` words by then. The first
   document keeps its copy.

A hot seed is one row per task before the join, and the skew join splits its
places; regions of a text that many chains ask for are cut out once. Words are
compared by 32-bit hashes in step 4 (a wrong match needs a 2^-32 collision at
the very place).

Edge cases: NULL, empty and short texts have no seeds and no passages; repeats
within one document only aren't reported; rows that repeat a doc_id are told
apart by their text, equal rows count as one document; a NULL doc_id comes
first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import marked_texts, skewed_join, staged, table, text_key
from ._text import _BASE, _INVERSE, WORDS, Words, _power, chunks, kgrams, list_array, mix, runs

K = 8
WINDOW = 16
GAP = 0.1
MAX_GAP = 48
PAD = K + WINDOW
MIN_WORDS = 50


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[i:i + width] for each i that has them all."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def seeds_of(w: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the winnowed k-grams of a chunk. At
    a text's ends shorter windows count too, so every text of k words has one."""
    at, h = kgrams(w.hash, w.doc, k)
    if not len(at):
        return at, h
    pad = window - 1
    doc = w.doc[at]
    place = np.arange(len(at)) + pad * (1 + np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]))
    line = np.full(int(place[-1]) + 1 + pad, np.iinfo(np.uint64).max, np.uint64)
    line[place] = h
    low = _sliding(line, window, np.minimum)
    chosen = _sliding(low, window, np.maximum)[place - pad] == h  # the smallest of some window around it
    return at[chosen], h[chosen]


def seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(seed, doc_id, at): at holds 32 bits of the text key and the word."""
    def run(batches):
        for b in batches:
            key = b.column(1).to_numpy() & ~np.int64(0xFFFFFFFF)
            for i, j, w in chunks(b, "text", WORDS):
                at, h = seeds_of(w, k, window)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0)[i:j].take(pa.array(doc)),
                                                  pa.array(key[i:j][doc] | w.index_in_doc()[at])], ["seed", "doc_id", "at"])
    return docs.select("doc_id", text_key(F.col("text")).alias("t"), "text").mapInArrow(run, "seed long, doc_id long, at long")


def _ordered_chains(order: np.ndarray, way: np.ndarray, k: int, gap: float) -> list[np.ndarray]:
    """The same for matches that are all in order already: the best predecessor
    is then the one just before (an earlier one pays at least as much), so the
    scores are one running maximum."""
    step = np.concatenate([[0.0], k - gap * (np.diff(way) - 2.0 * k)])
    total = np.cumsum(step)
    score = total + np.maximum.accumulate(k - total)
    starts = np.concatenate([[0], np.flatnonzero(score[:-1] + step[1:] <= k) + 1])
    out = []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        while a < b:  # what follows the best end is a chain of its own
            end = a + int(np.argmax(score[a:b])) + 1
            out.append((score[end - 1], order[a:end]))
            a = end
    return [c for _, c in sorted(out, key=lambda x: -x[0])]


def chain(q: np.ndarray, t: np.ndarray, k: int, gap: float = GAP) -> list[np.ndarray]:
    """Collinear chains of matches (q, t), best first, as index arrays in
    order; every match is in at most one."""
    order = np.lexsort((q, t))
    if len(q) < 2 or ((np.diff(q[order]) > 0).all() and (np.diff(t[order]) > 0).all()):
        return _ordered_chains(order, (q + t)[order], k, gap)
    rank = np.unique(q, return_inverse=True)[1] + 1
    size = int(rank.max(initial=0))
    tree, holder = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(q), [-1] * len(q)
    ql, tl, rl, ol = q.tolist(), t.tolist(), rank.tolist(), order.tolist()
    i = 0
    while i < len(ol):
        j = i
        while j < len(ol) and tl[ol[j]] == tl[ol[i]]:
            j += 1
        for x in ol[i:j]:  # ask before this t's own matches are put in
            r, best, who = rl[x] - 1, -1e18, -1
            while r > 0:
                if tree[r] > best:
                    best, who = tree[r], holder[r]
                r &= r - 1
            gained = best - gap * (ql[x] + tl[x] - 2 * k)
            score[x], before[x] = (k + gained, who) if gained > 0 else (float(k), -1)
        for x in ol[i:j]:
            r, value = rl[x], score[x] + gap * (ql[x] + tl[x])
            while r <= size:
                if value > tree[r]:
                    tree[r], holder[r] = value, x
                r += r & -r
        i = j
    used, out = [False] * len(q), []
    for x in sorted(range(len(q)), key=lambda x: -score[x]):
        path = []
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(x)
            x = before[x]
        if path:
            out.append(np.array(path[::-1]))
    return out


def _parts(q: np.ndarray, t: np.ndarray, max_gap: int) -> list[slice]:
    """A chain cut where it skips too much or drifts off its diagonal."""
    cut = np.flatnonzero((np.maximum(np.diff(q), np.diff(t)) > max_gap)) + 1
    return [slice(a, b) for a, b in zip([0, *cut], [*cut, len(q)])]


def _extend(same: np.ndarray) -> int:
    """How far to go along: the longest prefix whose running score (match 1,
    miss -3) is best, given up after a drop of 6."""
    total = np.cumsum(np.where(same, 1, -3))
    fall = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > 6)
    total = total[:fall[0]] if len(fall) else total
    return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, q: np.ndarray, t: np.ndarray, k: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (start, end in a, start, end in b, equal words) of a chain of
    matches at the words q of a and t of b."""
    out = []
    head = 0
    equal = k

    def close(i: int, j: int, equal: int) -> None:
        n = min(q[i], t[i])
        left = _extend(a[q[i] - n:q[i]][::-1] == b[t[i] - n:t[i]][::-1]) if n else 0
        n = min(len(a) - q[j] - k, len(b) - t[j] - k)
        right = _extend(a[q[j] + k:q[j] + k + n] == b[t[j] + k:t[j] + k + n]) if n > 0 else 0
        out.append((int(q[i] - left), int(q[j] + k + right), int(t[i] - left), int(t[j] + k + right), int(equal + left + right)))

    for i in range(1, len(q)):
        dq, dt = int(q[i] - q[i - 1]), int(t[i] - t[i - 1])
        if dq == dt:
            hit = int((a[q[i - 1] + k:q[i]] == b[t[i - 1] + k:t[i]]).sum()) + min(dq, k)
        else:
            x, y = a[q[i - 1] + k:max(q[i], q[i - 1] + k)].tolist(), b[t[i - 1] + k:max(t[i], t[i - 1] + k)].tolist()
            hit = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) + min(dq, dt, k)
        if max(dq, dt) - hit > 16 and hit < 0.5 * max(dq, dt):
            close(head, i - 1, equal)
            head, equal = i, k
        else:
            equal += hit
    close(head, len(q) - 1, equal)
    return out


def _regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tk, lo, hi, words): the word hashes of distinct regions."""
    per = staged(wanted.distinct().groupBy(F.col("doc_id").alias("_d"), F.col("tk").alias("_k")).agg(F.collect_list(F.struct("lo", "hi")).alias("r")), "passage-regions")
    texts = marked_texts(docs, per, "_k", F.shiftright(text_key(F.col("text")), 32)) \
        .join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", F.col("key").alias("tk"), "r", "text")

    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", WORDS):
                words = (w.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                row, lo, hi, cut = [], [], [], []
                for x, regions in enumerate(b.column(2)[i:j].to_pylist()):
                    own = words[w.first[x]:w.first[x + 1]]
                    for r in regions:
                        row.append(i + x)
                        lo.append(r["lo"])
                        hi.append(r["hi"])
                        cut.append(own[r["lo"]:r["hi"]])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                                                  list_array(np.concatenate(cut) if cut else np.zeros(0, np.int32), np.array([len(x) for x in cut], np.int64), pa.int32())],
                                                 ["doc_id", "tk", "lo", "hi", "words"])
    return texts.mapInArrow(run, "doc_id long, tk long, lo int, hi int, words array<int>").dropDuplicates(["doc_id", "tk", "lo", "hi"])


def aligned_pieces(docs: DataFrame, k: int = K, window: int = WINDOW, max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, tk, start, end, source_id, source_tk, source_start, source_end,
    equal): pieces of texts that repeat an earlier document's words."""
    return _aligned(docs, staged(seeds(docs, k, window), "passage-seeds"), k, max_gap)


def _aligned(docs: DataFrame, all_seeds: DataFrame, k: int, max_gap: int) -> DataFrame:
    heads = all_seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("n")).where("n > 1")
    tk = lambda c: F.shiftright(c, 32)
    word = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") if isinstance(c, str) else c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    met = skewed_join(all_seeds, heads.select("seed", F.col("head.doc_id").alias("s_id"), F.col("head.at").alias("s_at")), "seed") \
        .where(~(F.col("doc_id").eqNullSafe(F.col("s_id")) & (tk("at") == tk("s_at")))) \
        .select("doc_id", tk("at").alias("tk"), "s_id", tk("s_at").alias("s_tk"), word("at").alias("q"), word("s_at").alias("t")) \
        .withColumn("pair", F.xxhash64("doc_id", "tk", "s_id", "s_tk"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def chains(batches):
        for b in runs(batches):
            q, t = b.column(5).to_numpy(), b.column(6).to_numpy()
            if len(q) > 1:
                both = np.unique(t.astype(np.int64) << 32 | q)  # equal rows count once
                q, t = both & 0xFFFFFFFF, both >> 32
            kept = []
            for c in chain(q, t, k):
                for s in _parts(q[c], t[c], max_gap):
                    if s.stop - s.start > 1:
                        kept.append((q[c][s], t[c][s]))
            if kept:
                first = pa.array(np.zeros(len(kept), np.int64))
                num = lambda f: pa.array(np.array([f(x) for x in kept], np.int32))
                n = np.array([len(x[0]) for x in kept])
                yield pa.RecordBatch.from_arrays(
                    [b.column(x).take(first) for x in range(1, 5)]
                    + [num(lambda x: max(0, x[0][0] - PAD)), num(lambda x: x[0][-1] + k + PAD), num(lambda x: max(0, x[1][0] - PAD)), num(lambda x: x[1][-1] + k + PAD),
                       list_array(np.concatenate([x[0] for x in kept]), n, pa.int32()), list_array(np.concatenate([x[1] for x in kept]), n, pa.int32())],
                    ["doc_id", "tk", "s_id", "s_tk", "lo", "hi", "s_lo", "s_hi", "q", "t"])
    found = met.select("pair", "doc_id", "tk", "s_id", "s_tk", "q", "t").repartition(parts, "pair").sortWithinPartitions("pair") \
        .mapInArrow(chains, "doc_id long, tk long, s_id long, s_tk long, lo int, hi int, s_lo int, s_hi int, q array<int>, t array<int>")
    found = staged(found, "passage-chains")
    regions = staged(_regions(docs, found.select("doc_id", "tk", "lo", "hi").unionByName(
        found.select(F.col("s_id").alias("doc_id"), F.col("s_tk").alias("tk"), F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi")))), "passage-words")

    def with_words(df: DataFrame, d: str, key: str, lo: str, hi: str, name: str) -> DataFrame:
        r = regions.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k"), F.col("lo").alias("_l"), F.col("hi").alias("_h"), F.col("words").alias(name))
        return df.join(r, F.col(d).eqNullSafe(F.col("_d")) & (F.col(key) == F.col("_k")) & (F.col(lo) == F.col("_l")) & (F.col(hi) == F.col("_h"))).drop("_d", "_k", "_l", "_h")

    ready = with_words(with_words(found, "doc_id", "tk", "lo", "hi", "a"), "s_id", "s_tk", "s_lo", "s_hi", "b")

    def aligned(batches):
        for batch in batches:
            rows, pieces = [], []
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            lo, s_lo = get("lo").to_numpy(), get("s_lo").to_numpy()
            cols = [get(x) for x in ("a", "b", "q", "t")]
            flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in cols]
            for r in range(batch.num_rows):
                a, b, q, t = (v[o[r]:o[r + 1]] for v, o in flat)
                for x0, x1, y0, y1, n in align(a, b, q - lo[r], t - s_lo[r], k):
                    rows.append(r)
                    pieces.append((x0 + lo[r], x1 + lo[r], y0 + s_lo[r], y1 + s_lo[r], n))
            at = pa.array(rows, pa.int64())
            p = np.array(pieces, np.int32).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([get(x).take(at) for x in ("doc_id", "tk", "s_id", "s_tk")] + [pa.array(p[:, x]) for x in range(5)],
                                             ["doc_id", "tk", "source_id", "source_tk", "start", "end", "source_start", "source_end", "equal"])
    return ready.select("doc_id", "tk", "s_id", "s_tk", "lo", "s_lo", "q", "t", "a", "b").mapInArrow(
        aligned, "doc_id long, tk long, source_id long, source_tk long, start int, end int, source_start int, source_end int, equal int")


def _stretches(all_seeds: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """(doc_id, tk, lo, hi): stretches of texts that hold every run of
    ``min_words`` words another document has too. Any ``window`` k-grams within
    such a run share a seed, so its common seeds are at most ``window`` apart
    and the first and last less than ``window`` from its ends."""
    owner = F.struct("doc_id", F.shiftright("at", 32).alias("tk"))
    common = all_seeds.groupBy("seed").agg(F.min(owner).alias("a"), F.max(owner).alias("z")).where("a <> z").select("seed")
    at = skewed_join(all_seeds, common, "seed").select("doc_id", F.shiftright("at", 32).alias("tk"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("p"))
    by = W.partitionBy("doc_id", "tk").orderBy("p")
    new = F.coalesce(F.col("p") - F.lag("p").over(by) > window, F.lit(True)).cast("int")
    return at.withColumn("_new", new).withColumn("_g", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))) \
        .groupBy("doc_id", "tk", "_g").agg((F.min("p") - (window - 1)).alias("lo"), (F.max("p") + k + window - 1).alias("hi")) \
        .where(F.col("hi") - F.greatest("lo", F.lit(0)) >= min_words).select("doc_id", "tk", "lo", "hi")


def long_grams(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on (also across texts), from one running sum."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _power(_BASE, len(w.hash)), dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * _power(_INVERSE, len(w.hash))[:len(total) - n])


def anchored(w: Words, asked: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The asked n-word runs (by first word) in groups of neighbours: each group's
    first run (as its number in ``asked``), anchor hash and content hash, and every
    run's hash. A run's anchor is its k-gram of smallest hash, the leftmost of
    ties, so equal runs have equal anchors."""
    if not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k = min(k, n)
    small = long_grams(w, k)
    bits = np.uint64(max(24, len(small).bit_length()))
    place = _sliding((small >> bits) << bits | np.arange(len(small), dtype=np.uint64), n - k + 1, np.minimum)[asked]
    place = (place & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    h = long_grams(w, n)[asked]
    first = np.concatenate([[0], np.flatnonzero((np.diff(asked) != 1) | (np.diff(place) != 0)) + 1])
    size = np.diff(np.append(first, len(asked))).astype(np.uint64)
    content = mix(np.add.reduceat(h * _power(_BASE, len(h)), first) * _power(_INVERSE, len(h))[first] + size)
    return first, small[place[first]], content, h


def exact_runs(docs: DataFrame, all_seeds: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """(doc_id, tk, start, end, source_id, source_start, equal): every run of
    ``min_words`` equal words or more that an earlier document has, by the
    document that has it first; ``equal`` and ``source_start`` are those of the
    longest run on one diagonal. Neighbouring runs with one anchor are one row.
    If all rows of an anchor have the same content, the first of them is the
    first place of all its runs; only other anchors' runs are joined singly."""
    per = staged(_stretches(all_seeds, k, window, min_words).groupBy(F.col("doc_id").alias("_d"), F.col("tk").alias("_k"))
                 .agg(F.collect_list(F.struct("lo", "hi")).alias("r")), "passage-stretches")
    texts = marked_texts(docs, per, "_k", F.shiftright(text_key(F.col("text")), 32)) \
        .join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", "key", "r", "text")

    def grams(batches):
        for b in batches:
            key = b.column(1).to_numpy() << 32
            for i, j, w in chunks(b, "text", WORDS):
                edge = np.zeros(len(w.hash) + 1, np.int64)
                for x, regions in enumerate(b.column(2)[i:j].to_pylist()):
                    a, z = w.first[x], w.first[x + 1]
                    for r in regions:
                        lo, hi = a + max(r["lo"], 0), min(a + r["hi"], z) - min_words + 1
                        if hi > lo:
                            edge[lo] += 1
                            edge[hi] -= 1
                asked = np.flatnonzero(np.cumsum(edge[:-1]))
                first, anchor, content, h = anchored(w, asked, k, min_words)
                at = asked[first]
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), b.column(0)[i:j].take(pa.array(doc)), pa.array(key[i:j][doc] | w.index_in_doc()[at]),
                     list_array(h.view(np.int64), np.diff(np.append(first, len(asked))), pa.int64())], ["anchor", "content", "doc_id", "at", "grams"])
    tk = lambda c: F.shiftright(c, 32)
    other = ~(F.col("doc_id").eqNullSafe(F.col("s_id")) & (tk("at") == tk("s_at")))
    groups = staged(texts.mapInArrow(grams, "anchor long, content long, doc_id long, at long, grams array<long>"), "passage-groups")
    owner = F.struct("doc_id", tk("at").alias("tk"))
    anchors = groups.groupBy("anchor").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.min(owner).alias("a"), F.max(owner).alias("z"),
                                           (F.min("content") != F.max("content")).alias("mixed")).where("a <> z")
    met = staged(skewed_join(groups, anchors.select("anchor", "mixed", F.col("head.doc_id").alias("s_id"), F.col("head.at").alias("s_at")), "anchor")
                 .where(F.col("mixed") | other)
                 .select("doc_id", "at", "s_id", "s_at", "mixed", F.size("grams").alias("n"), F.when(F.col("mixed"), F.col("grams")).alias("grams")), "passage-anchors")
    placed = met.where("mixed").select("doc_id", "at", F.posexplode("grams").alias("i", "run")).select("run", "doc_id", (F.col("at") + F.col("i")).alias("at"))
    first = placed.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("n")).where("n > 1")
    single = skewed_join(placed, first.select("run", F.col("head.doc_id").alias("s_id"), F.col("head.at").alias("s_at")), "run").where(other)
    found = met.where("not mixed").select("doc_id", "at", "s_id", "s_at", "n").unionByName(single.select("doc_id", "at", "s_id", "s_at", F.lit(1).alias("n")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def joined(batches):
        for b in runs(batches):
            n = b.column(5).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at, one = np.unique(b.column(3).to_numpy()[row] + step, return_index=True)  # equal rows count once
            s, own = b.column(4).to_numpy()[row[one]] + step[one], b.column(2).take(pa.array(row[one]))
            none = own.is_null().to_numpy(zero_copy_only=False)
            source = own.fill_null(0).to_numpy()
            breaks = (np.diff(at) != 1) | (np.diff(s >> 32) != 0) | (np.diff(source) != 0) | (none[1:] != none[:-1])
            piece = np.concatenate([[0], np.flatnonzero(breaks) + 1])
            line = np.concatenate([[0], np.flatnonzero(breaks | (np.diff(s) != 1)) + 1])
            size = np.diff(np.append(line, len(at)))
            of = np.searchsorted(piece, line, side="right") - 1
            order = np.lexsort((line, -size, of))
            best = order[np.concatenate([[True], np.diff(of[order]) != 0])]
            last = np.append(piece[1:], len(at)) - 1
            word = lambda x: pa.array((x & 0xFFFFFFFF).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(np.zeros(len(piece), np.int64))), pa.array(at[piece] >> 32), word(at[piece]), word(at[last] + min_words), own.take(pa.array(piece)),
                 word(s[line[best]]), pa.array((size[best] + min_words - 1).astype(np.int32))], ["doc_id", "tk", "start", "end", "source_id", "source_start", "equal"])
    return found.select(F.xxhash64("doc_id", tk("at")).alias("pair"), "doc_id", "s_id", "at", "s_at", "n").repartition(parts, "pair").sortWithinPartitions("pair") \
        .mapInArrow(joined, "doc_id long, tk long, start int, end int, source_id long, source_start int, equal int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, tk, start, end, source_id, source_start, equal): one row per
    repeated passage, words from ``start`` up to before ``end``; source_id is
    the document that keeps the (longest piece of the) passage."""
    by = W.partitionBy("doc_id", "tk").orderBy("start", "end")
    upto = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    all_seeds = staged(seeds(docs, k, window), "passage-seeds")
    names = ("doc_id", "tk", "start", "end", "source_id", "source_start", "equal")
    one = ("doc_id", "tk", "source_id", "source_tk")
    before = W.partitionBy(*one).orderBy("start", "end")
    span = W.partitionBy(*one, "_s")
    pieces = _aligned(docs, all_seeds, k, MAX_GAP) \
        .withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)) + 2, F.lit(True)).cast("int")) \
        .withColumn("_s", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, W.currentRow))) \
        .withColumn("_n", F.max("end").over(span) - F.min("start").over(span)).where(F.col("_n") >= min_words).select(*names).unionByName(exact_runs(docs, all_seeds, k, window, min_words))
    grouped = pieces.withColumn("_new", F.coalesce(F.col("start") > upto + 2, F.lit(True)).cast("int")) \
        .withColumn("_g", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy("doc_id", "tk", "_g").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.max(F.struct(F.col("equal"), -F.col("source_start"), "source_id", "source_start")).alias("m")) \
        .where(F.col("end") - F.col("start") >= min_words) \
        .select("doc_id", "tk", "start", "end", F.col("m.source_id").alias("source_id"), F.col("m.source_start").alias("source_start"), F.col("m.equal").alias("equal"))


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without their repeated passages: same columns, n_chars
    renewed if there is one; documents that had words and have none left go."""
    per = staged(passages.groupBy(F.col("doc_id").alias("__id"), F.col("tk").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans")), "passage-cuts")
    names = docs.columns
    joined = docs.withColumn("__tk", F.shiftright(text_key(F.col("text")), 32)) \
        .join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tk") == F.col("__k")), "left")

    def run(batches):
        for b in batches:
            texts = []
            for i, j, w in chunks(b, "text", WORDS):
                for x, spans in enumerate(b.column(len(names))[i:j].to_pylist()):
                    lo, hi = w.offsets[x], w.offsets[x + 1]
                    start = np.append(w.start[w.first[x]:w.first[x + 1]], hi)
                    n, out, at = len(start) - 1, [], lo
                    for s in spans:
                        out.append(w.data[at:max(at, start[min(s["start"], n)])].tobytes())
                        at = max(at, start[min(s["end"], n)])
                    texts.append(b"".join([*out, w.data[at:hi].tobytes()]).decode("utf-8", "replace").strip())
            k = names.index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == k else b.column(c) for c in range(len(names))], [f"c{c}" for c in range(len(names))])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    touched = joined.where("__spans is not null").select(*names, "__spans") \
        .mapInArrow(run, ", ".join(f"c{c} {kinds[x]}" for c, x in enumerate(names))).toDF(*names).where(F.length("text") > 0)
    if "n_chars" in names:
        touched = touched.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return joined.where("__spans is null").select(*names).unionByName(touched.select(*names))


def op5_chained_passages(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("first_word"), (F.col("end") - F.col("start")).alias("n_words"), "source_id",
                        F.col("source_start").alias("source_word"), F.col("equal").alias("n_equal"))
