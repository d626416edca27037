"""Language-model scoring with a probabilistic suffix tree, kept as tables.

Contexts are runs of up to ``max_order`` tokens (a start mark may be the first);
they grow level by level. A context of at least ``min_context`` occurrences is
kept if its next-token distribution differs from its suffix's by a divergence
test (Kullback-Leibler, per occurrence and against chance). Its entries are the
next tokens seen at least ``min_entry`` times after it, smoothed into the suffix:

    P(s | c) = (n(c, s) + L * P(s | suffix of c)) / (n(c) + k),

k being the number of entries and L that number plus the occurrences without an
entry, so that the probabilities of all tokens sum to 1; a context that isn't
kept takes its suffix's. The root is the unigram distribution (c + 0.1).

Both minima are counts, not shares, so contexts and entries grow with the
corpus. A run of tokens is known by its hash, and one table holds per run the
log gain of its last token as an entry of the run before it, and the log
back-off weight of the run as a context. These are additive: a text's score is
its unigram score plus the values of all its runs, so texts ask for keys, and
need no tree.

What reaches the tasks is bounded whatever the corpus: bitmaps of 8 MB that let
through the runs that can matter (an exact join follows), and the values of runs
that hold ``hot_share`` of all tokens, at most 1 / hot_share per run length; all
other runs of the texts are joined to the table, so no key of that join is hot
in the training texts. Counts are combined in the tasks before they are shuffled.

Edge cases: a NULL text is empty: one end token; a NULL doc_id is learned from
and not held out; rows that repeat a doc_id are scored each for itself; with
nothing to learn from all counts and scores are 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_remainder, hash_bitmap, marked, staged, table
from ._text import TOKENS, Words, chunks, in_sorted, list_array, mix, unmix
from ._text import runs as grouped

CHUNK, SCORE_CHUNK = 2 << 20, 1 << 20  # bytes of text whose arrays a task holds at a time
START_HASH, END_HASH = np.uint64(0x005A1C39D25), np.uint64(0x00E4D0F7E87)  # no word's hashes but by chance 2^-64
BITS = 26
HELD = 2 << 20  # runs that a task counts before it passes them on
GROUP_BITS = 12
SHARES, SHARE_TOKENS = 2, 1 << 20
ROUNDS, ROUND_KEYS = 4, 1 << 20


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts, the end of text included."""
    def run(batches):
        for b in batches:
            for _, _, w in chunks(b, "text", TOKENS, CHUNK):
                token, n = np.unique(w.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(token, END_HASH).view(np.int64)),
                                                  pa.array(np.append(n, w.n_docs).astype(np.int64))], ["token", "c"])
    return texts.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def longer(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a run from those of the run without its last token and of the
    run without its first."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + last)


def suffix(run: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What ``longer`` was given as ``last``, from its result and ``before``."""
    return unmix(run) - before * np.uint64(0x9E3779B97F4A7C15)


class Stream:
    """The tokens of a chunk, every text between a start and an end mark;
    ``depth``: the place in the text, ``doc`` the text of each place."""

    def __init__(self, w: Words):
        d = np.arange(w.n_docs)
        lead = w.first[:-1] + 2 * d
        self.s = np.full(len(w.start) + 2 * w.n_docs, END_HASH, np.uint64)
        self.s[lead] = START_HASH
        self.s[np.arange(len(w.start)) + 2 * w.doc + 1] = w.hash
        self.depth = np.arange(len(self.s)) - np.repeat(lead, w.counts() + 2)
        self.doc = np.repeat(d, w.counts() + 2)

    def runs(self):
        """Per length 1, 2, ...: (the places where a run of that length ends, the
        hash of the run that ends at each place; elsewhere it means nothing)."""
        h, k = self.s, 1
        while True:
            yield np.flatnonzero(self.depth >= k - 1), h
            h, k = np.concatenate([h[:1], longer(h[:-1], h[1:])]), k + 1


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, low half of its context, count) of the distinct runs, by run."""
    g, c, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], c[order[first]], np.add.reduceat(n[order], first) if len(g) else n


def next_counts(texts: DataFrame, order: int, contexts, tokens, min_entry: int, share: int = 0, shares: int = 1) -> DataFrame:
    """(g, cl, n): how often the run ``g`` of ``order`` + 1 tokens occurs, for
    those whose context (without the last token) and suffix (without the first)
    the two bitmaps mark and that occur ``min_entry`` times; ``cl`` is the low
    half of the context's hash. A task's counts are shuffled as one row per
    range of hashes, so a run costs 12 bytes and its count; of ``shares`` parts
    of the ranges only part ``share`` is counted."""
    def rows(parts):
        g, c, n = _summed(parts)
        group = (g >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(g) else np.zeros(0, np.int64)
        ends = np.append(first, len(g))
        for x in range(0, len(first), 512):
            y = min(x + 512, len(first))
            i, j, size = ends[x], ends[y], np.diff(ends[x:y + 1])
            yield pa.RecordBatch.from_arrays([pa.array(group[first[x:y]]), list_array(g[i:j].view(np.int64), size, pa.int64()),
                                              list_array(c[i:j].view(np.int32), size, pa.int32()), list_array(n[i:j], size, pa.int64())], ["group", "g", "cl", "n"])

    def found(w: Words):
        st = Stream(w)
        steps = st.runs()
        for _ in range(order):
            _, h = next(steps)
        at = np.flatnonzero(st.depth >= order)
        at = at[marked(contexts.value, h[at - 1], BITS)]
        at = at[marked(tokens.value, h[at], BITS)]
        g = longer(h[at - 1], h[at])
        if shares > 1:
            mine = (g >> np.uint64(64 - GROUP_BITS)) % np.uint64(shares) == share
            at, g = at[mine], g[mine]
        g, first, n = np.unique(g, return_index=True, return_counts=True)
        return g, h[at[first] - 1].astype(np.uint32), n.astype(np.int64)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, w in chunks(b, "text", TOKENS, CHUNK):
                held.append(found(w))
                size += len(held[-1][0])
                if size >= HELD:
                    del w
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    def total(batches):
        for b in grouped(batches):
            g, c, n = _summed([tuple(b.column(x).flatten().to_numpy(zero_copy_only=False) for x in (1, 2, 3))])
            keep = n >= min_entry
            yield pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(c[keep]), pa.array(n[keep])], ["g", "cl", "n"])
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.select("text").mapInArrow(run, "group long, g array<long>, cl array<int>, n array<long>") \
        .repartition(parts, "group").sortWithinPartitions("group").mapInArrow(total, "g long, cl int, n long")


def _named(counts: DataFrame) -> DataFrame:
    """(g, c, n, cn) with the suffix ``s`` of the run ``g`` of context ``c``. A
    context that only shares its low half gives a hash that is no run's."""
    def run(batches):
        for b in batches:
            s = suffix(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.view(np.int64))], ["g", "c", "n", "cn", "s"])
    return counts.mapInArrow(run, "g long, c long, n long, cn long, s long")


def _tested(own: DataFrame, min_kl: float) -> DataFrame:
    """(ctx, free, whole): the contexts that pass the divergence test, the mass
    they leave to their suffix and their whole mass."""
    sums = own.groupBy(F.col("c").alias("ctx")).agg(
        F.max("cn").alias("cn"), F.sum("n").alias("held"), F.count("*").alias("kinds"), F.sum("low").alias("covered"),
        F.sum(F.col("n") * (F.log(F.col("n") / F.col("cn")) - F.log("low"))).alias("gain"))
    rest = 1 - F.col("held") / F.col("cn")  # what has no entry is compared as one
    kl = F.col("gain") / F.col("cn") + F.when(rest > 0, rest * F.log(rest / F.greatest(1 - F.col("covered"), F.lit(1e-12)))).otherwise(0.0)
    return sums.withColumn("kl", kl).where((F.col("kl") >= min_kl) & (2 * F.col("cn") * F.col("kl") >= F.col("kinds") + 4 * F.sqrt(2.0 * F.col("kinds")))) \
        .select("ctx", (F.col("kinds") + F.col("cn") - F.col("held")).alias("free"), (F.col("kinds") + F.col("cn")).alias("whole"))


def learn(texts: DataFrame, max_order: int = 3, min_context: int = 64, min_entry: int = 16, min_kl: float = 0.01) -> tuple[DataFrame, dict]:
    """(the tree as a table, its totals). The table has per run: ``key``; ``v``,
    what the run adds to a score beyond unigrams; ``b``, for single tokens
    log10(c + 0.1) + 1 (0 for runs of more); ``n``, its training count."""
    counts = staged(token_counts(texts).where("c > 0"), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    mass = n + 0.1 * (v + 1)
    shares = min(SHARES, 1 + n // SHARE_TOKENS)  # counted one after the other, so only one share's counts are on the disks
    parts = [counts.select(F.col("token").alias("key"), F.lit(0.0).alias("v"), (F.log10(F.col("c") + F.lit(0.1)) + 1).alias("b"), F.col("c").alias("n"))]
    # runs of one token: how often, and their probability in the root
    runs = counts.where(F.col("c") >= min_entry).select(F.col("token").alias("g"), F.col("c").alias("n"), ((F.col("c") + F.lit(0.1)) / mass).alias("p"))
    starts = counts.where(F.col("token") == int(END_HASH)).select(F.lit(int(START_HASH)).cast("bigint").alias("g"), F.col("c").alias("n"))
    contexts = runs.select("g", "n").unionByName(starts).where(F.col("n") >= min_context)
    for order in range(1, max_order + 1):
        if not contexts.limit(1).count():
            break
        marks = hash_bitmap(contexts, "g", BITS), hash_bitmap(runs, "g", BITS)
        raw = reduce(DataFrame.unionByName, [staged(next_counts(texts, order, *marks, min_entry, x, shares), f"lm-next{order}") for x in range(shares)])
        own = raw.withColumn("cl", F.col("cl").cast("bigint")) \
            .join(contexts.select(F.col("g").alias("c"), F.col("n").alias("cn"), F.shiftright(F.shiftleft("g", 32), 32).alias("cl")), "cl")
        own = _named(own.select("g", "c", "n", "cn")).join(runs.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
        own = staged(own.select("g", "c", "n", "cn", "low"), f"lm-runs{order}")
        kept = staged(_tested(own, min_kl).join(contexts.withColumnRenamed("g", "ctx"), "ctx"), f"lm-contexts{order}")
        back = F.log10(F.col("free") / F.col("whole"))
        tree = own.join(kept.select("ctx", "free", "whole"), F.col("c") == F.col("ctx"), "left") \
            .withColumn("p", F.coalesce((F.col("n") + F.col("free") * F.col("low")) / F.col("whole"), "low"))
        # a context whose every occurrence has an entry still leaves mass: free >= kinds >= 1
        tree = staged(tree.select("g", "n", "p", (F.log10(F.col("p") / F.col("low")) - back).alias("v")), f"lm-tree{order}")
        parts += [kept.select(F.col("ctx").alias("key"), back.alias("v"), F.lit(0.0).alias("b"), "n"),
                  tree.where("v is not null").select(F.col("g").alias("key"), "v", F.lit(0.0).alias("b"), "n")]
        runs = tree.select("g", "n", "p")
        contexts = runs.select("g", "n").where(F.col("n") >= min_context)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return staged(whole.groupBy("key").agg(F.sum("v").alias("v"), F.sum("b").alias("b"), F.max("n").alias("n")), "lm-tree"), \
        {"n": n, "v": v, "order": max_order}


def score(docs: DataFrame, tree: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), hot_share: float = 1e-6) -> DataFrame:
    """``keep`` columns of every row, n_tokens, n_known, train_tokens,
    base_score (unigrams) and score (suffix tree), log10."""
    least = max(1.0, hot_share * model["n"])
    hot = tree.where(F.col("n") >= least).select("key", "v", "b").toPandas()  # at most 1 / hot_share per run length
    key = hot["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    far = tree.where(F.col("n") < least)
    shared = docs.sparkSession.sparkContext.broadcast((key[order], hot["v"].to_numpy()[order], hot["b"].to_numpy()[order]))
    low, high = hash_bitmap(far, "key", BITS), hash_bitmap(far.select(F.shiftrightunsigned("key", BITS).alias("key")), "key", BITS)
    names, kinds = list(keep), {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    lengths = model["order"] + 1

    def run(batches):
        keys, v, b1 = shared.value
        for b in batches:
            for i, j, w in chunks(b, "_text", TOKENS, SCORE_CHUNK):
                st = Stream(w)
                known, base, more = np.zeros(w.n_docs, np.int64), np.zeros(w.n_docs), np.zeros(w.n_docs)
                asked, of = [], []
                for _, (at, h) in zip(range(lengths), st.runs()):
                    uniq, inv = np.unique(h[at], return_inverse=True)
                    found, x = in_sorted(keys, uniq)
                    doc = st.doc[at]
                    if found.any():
                        for into, value in ((base, b1), (more, v)):
                            into += np.bincount(doc, np.where(found, value[x], 0.0)[inv], w.n_docs)
                        known += np.bincount(doc, (found & (b1[x] > 0))[inv], w.n_docs).astype(np.int64)
                    may = ~found & marked(low.value, uniq, BITS) & marked(high.value, uniq >> np.uint64(BITS), BITS)
                    open_ = np.flatnonzero(may[inv])
                    asked.append(h[at[open_]])
                    of.append(doc[open_])
                asked, of = np.concatenate(asked), np.concatenate(of)
                yield pa.RecordBatch.from_arrays(
                    [b.column(x)[i:j] for x in range(len(names))]
                    + [pa.array((w.counts() + 1).astype(np.int64)), pa.array(known), pa.array(base), pa.array(more),
                       list_array(asked[np.argsort(of, kind="stable")].view(np.int64), np.bincount(of, minlength=w.n_docs), pa.int64())],
                    [f"c{x}" for x in range(len(names))] + ["n_tokens", "known", "base", "more", "far"])
    schema = ", ".join([f"c{x} {kinds[k]}" for x, k in enumerate(names)] + ["n_tokens long, known long, base double, more double, far array<long>"])
    read = docs.select(*[F.col(k).alias(f"c{x}") for x, k in enumerate(names)], F.col("text").alias("_text"))
    part = staged(read.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    keys = part.agg(F.sum(F.size("far"))).first()[0] or 0
    rounds = min(ROUNDS, 1 + keys // ROUND_KEYS)
    got = []
    for r in range(rounds):  # a share of the keys at a time is shuffled
        mine = F.pmod("key", F.lit(rounds)) == r
        asked = part.select("row", F.explode("far").alias("key")).where(mine)
        got.append(staged(asked.join(far.where(mine).select("key", "v", "b"), "key").groupBy("row").agg(
            F.sum("v").alias("far_v"), F.sum("b").alias("far_b"), F.count_if(F.col("b") > 0).alias("met")), f"lm-met{r}"))
    got = reduce(DataFrame.unionByName, got).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("far_v", "far_b", "met")])
    unseen = -1 - float(np.log10(model["n"] + 0.1 * (model["v"] + 1)))  # log10 share of a token never seen
    base = F.col("n_tokens") * F.lit(unseen) + F.col("base") + F.coalesce("far_b", F.lit(0.0))
    return part.drop("far").join(got, "row", "left").select(
        *[F.col(f"c{x}").alias(k) for x, k in enumerate(names)], "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(model["n"]).cast("bigint").alias("train_tokens"), base.alias("base_score"), (base + F.col("more") + F.coalesce("far_v", F.lit(0.0))).alias("score"))


def op6_suffix_tree(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    tree, model = learn(docs.where("not held_out"))
    return score(docs, tree, model, ("doc_id", "held_out"))
