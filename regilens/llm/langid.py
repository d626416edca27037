"""Language identification, words first.

Training counts every word of every labelled text per language. A word that
holds at least ``min_share`` of some language's training words is known: it adds
its log frequency in each language, smoothed towards its frequency over all
languages (so a language with little text gains nothing from words it never
had). An unknown word backs off to its
character n-grams, longest first: the mean log frequency of its known 4-grams,
else of its 3-grams, and so on. A document's language has the largest sum of
word votes and log prior; its score is the softmax share of that sum.

That share says which language, not whether it is one. ``predict(fit=True)`` adds
a length-normalised ``fit`` to the language found: the mean over words of 0 for a
known word, else its 4-grams' mean log ratio to independent letters, at most 0.
A 4-gram not known has the ratio of ``BACKGROUND`` draws of letters to all,
log(B / (total + B)); none is below ``LEAST_RATIO``. So fit is 0 for a text in a
language's words and near that bound for strings of letters; where little text
is learned from it stays near 0 and condemns nothing.

Statistics cover all training texts. What reaches the tasks is bounded by the
shares, not by the corpus: at most 1 / min_share words and 1 / min_gram_share
n-grams of each length and language can hold such a share (250,000 and 500,000
by default). Texts never move; only per-task word counts are shuffled,
summed on the map side, so a frequent word is one row per task.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0; a
NULL lang isn't learned; with nothing learned every text is ``und``; ties go to
the smaller language name; a letter-bearing text without any known word or
n-gram gets the most frequent language; rows that repeat a doc_id are judged
each for itself; an empty table gives an empty result; extra columns pass only
if named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_remainder, staged, table
from ._text import LETTERS, chunks, in_sorted, mix

ORDERS = (4, 3, 2, 1)
PRIOR = 50.0
BACKGROUND, LEAST_RATIO = 10_000.0, -6.0


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, h, word, n) over all words of the texts."""
    def run(batches):
        for b in batches:
            langs, code = np.unique(np.asarray(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for i, j, w in chunks(b, "text", LETTERS, 2 << 20, lower=True):
                lang = code[i:j][w.doc]
                order = np.lexsort((w.hash, lang))
                h, g = w.hash[order], lang[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, int)
                at = order[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[g[new]].tolist(), pa.string()), pa.array(h[new].view(np.int64)), pa.array([w.text(x) for x in at], pa.string()),
                     pa.array(np.diff(np.append(new, len(h))).astype(np.int64))], ["lang", "h", "word", "n"])
    return labelled.select("text", "lang").mapInArrow(run, "lang string, h long, word string, n long") \
        .groupBy("lang", "h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def word_grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of the character n-grams of the words, each with a
    mark before and after it."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    cp = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(cp) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(of[:len(cp) - n + 1] == of[n - 1:])
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x100000001B3) + cp[at + j])
    return of[at], h


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, h, n): n-grams of the distinct words, weighted by their counts."""
    def run(batches):
        for b in batches:
            langs, code = np.unique(np.asarray(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            words, weight = b.column(1).to_pylist(), b.column(2).to_numpy()
            for size in ORDERS:
                of, h = word_grams(words, size)
                order = np.lexsort((h, code[of]))
                hs, g, n = h[order], code[of][order], weight[of][order]
                new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (g[1:] != g[:-1])])) if len(hs) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[g[new]].tolist(), pa.string()), pa.array(np.full(len(new), size, np.int32)), pa.array(hs[new].view(np.int64)),
                     pa.array(np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64))], ["lang", "size", "h", "n"])
    return words.select("lang", "word", "n").mapInArrow(run, "lang string, size int, h long, n long") \
        .groupBy("lang", "size", "h").agg(F.sum("n").alias("n"))


def _log_table(pdf, langs: list[str], totals: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, log frequency per language) of counts (lang, h, n).
    Each language's counts are smoothed by ``PRIOR`` drawn from the frequencies
    over all languages: a language of little text believes what all say, so its
    silence on a word never counts for it."""
    keys, row = np.unique(pdf["h"].to_numpy().view(np.uint64), return_inverse=True)
    n = np.zeros((len(keys), len(langs)))
    np.add.at(n, (row, np.searchsorted(langs, pdf["lang"].to_numpy().astype(str))), pdf["n"].to_numpy())
    size = np.array([totals.get(x, 0) for x in langs], float)
    overall = n.sum(1) / max(1, size.sum())
    return keys, np.log((n + PRIOR * overall[:, None]) / (size + PRIOR)).astype(np.float32)


def _often(counts: DataFrame, totals: dict[str, float], share: float) -> DataFrame:
    """(k): entries that hold ``share`` of some language's total."""
    least = F.lit(0.0) if not totals else F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, share * float(n))]), F.col("lang"))
    return counts.where(F.col("n") >= least).select(F.col("h").alias("k")).distinct()


def learn(labelled: DataFrame, min_share: float = 4e-6, min_gram_share: float = 2e-6) -> dict:
    """The model from rows with ``text`` and ``lang``: bounded arrays."""
    labelled = labelled.where("lang is not null")
    words = staged(word_counts(labelled), "lang-words")
    prior = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(prior)
    known = words.join(_often(words, totals, min_share), F.col("h") == F.col("k"))
    model = {"langs": langs, "prior": np.log(np.array([prior[x] for x in langs], float) / max(1, sum(prior.values()))).astype(np.float32),
             "words": _log_table(known.select("lang", "h", "n").toPandas(), langs, totals), "grams": {}, "size": {}}
    grams = staged(gram_counts(words), "lang-grams")
    sums = grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).toPandas()
    for size in ORDERS:
        of = sums[sums["size"] == size]
        own, all_ = grams.where(F.col("size") == size), dict(zip(of["lang"], of["n"]))
        model["size"][size] = np.array([all_.get(x, 0) for x in langs], float)
        model["grams"][size] = _log_table(own.join(_often(own, all_, min_gram_share), F.col("h") == F.col("k")).select("lang", "h", "n").toPandas(), langs, all_)
    return model


def word_votes(words: list[str], hashes: np.ndarray, model: dict) -> np.ndarray:
    """Log frequency per language of each word, backing off to its n-grams."""
    keys, logs = model["words"]
    votes = np.zeros((len(words), len(model["langs"])), np.float32)
    found, at = in_sorted(keys, hashes)
    votes[found] = logs[at[found]]
    open_ = np.flatnonzero(~found)
    for size in ORDERS:
        if not len(open_):
            break
        of, h = word_grams([words[x] for x in open_], size)
        keys, logs = model["grams"][size]
        ok, at = in_sorted(keys, h)
        of, at = of[ok], at[ok]
        n = np.bincount(of, minlength=len(open_))
        for k in range(votes.shape[1]):
            votes[open_, k] = np.bincount(of, logs[at, k], len(open_)) / np.maximum(n, 1)
        open_ = open_[n == 0]
    return votes


def word_fits(words: list[str], hashes: np.ndarray, model: dict) -> np.ndarray:
    """How well each word fits each language, at most 0 (see above)."""
    fits = np.zeros((len(words), len(model["langs"])), np.float32)
    open_ = np.flatnonzero(~in_sorted(model["words"][0], hashes)[0])
    if not len(open_):
        return fits
    strange, n = [words[x] for x in open_], len(open_)
    (of, h), (of1, h1) = word_grams(strange, ORDERS[0]), word_grams(strange, 1)
    (keys, logs), (keys1, logs1) = model["grams"][ORDERS[0]], model["grams"][1]
    (ok, at), (ok1, at1) = in_sorted(keys, h), in_sorted(keys1, h1)
    grams, letters = np.bincount(of, minlength=n), np.bincount(of1, minlength=n)
    for k in range(fits.shape[1]):
        least = max(np.log(BACKGROUND / (model["size"][ORDERS[0]][k] + BACKGROUND)), LEAST_RATIO)
        rare = np.log(PRIOR / (model["size"][1][k] + PRIOR))  # a letter not known
        alone = np.bincount(of1, np.where(ok1, logs1[at1, k], rare) if len(keys1) else np.full(len(of1), rare), n) / np.maximum(letters, 1)
        ratio = np.where(ok, np.maximum(logs[at, k] - ORDERS[0] * alone[of], least), least) if len(keys) else np.full(len(of), least)
        fits[open_, k] = np.minimum(np.bincount(of, ratio, n) / np.maximum(grams, 1), 0)
    return fits


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), fit: bool = False) -> DataFrame:
    """``keep`` columns of every row, lang_pred and score; with ``fit`` also that."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)
    sent = names + ([] if "text" in names else ["text"])  # the text goes to Python once
    at = sent.index("text")
    added = ["lang_pred", "score"] + (["fit"] if fit else [])

    def run(batches):
        m = shared.value
        langs = m["langs"]
        for b in batches:
            raw = b.column(at)
            for i, j, w in chunks(b, f"c{at}", LETTERS, lower=True):
                uniq, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                words = [w.text(x) for x in first]
                votes = word_votes(words, uniq, m) if langs else np.zeros((len(uniq), 0), np.float32)
                total = np.stack([np.bincount(w.doc, votes[inv, k], w.n_docs) + m["prior"][k] for k in range(len(langs))], 1) if langs else np.zeros((w.n_docs, 0))
                plain = np.concatenate([[0], np.cumsum(((w.data >= 65) & (w.data <= 90)) | ((w.data >= 97) & (w.data <= 122)))])
                letters = (plain[w.offsets[1:]] - plain[w.offsets[:-1]]) > 0
                for r in np.flatnonzero(~letters & (w.counts() > 0)):
                    letters[r] = any(c.isalpha() for c in raw[i + int(r)].as_py())
                good = letters & bool(langs)
                best = total.argmax(1) if langs else np.zeros(w.n_docs, int)
                share = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1) if langs else np.zeros(w.n_docs)
                out = [pa.array([langs[x] if ok else "und" for x, ok in zip(best, good)], pa.string()), pa.array(np.where(good, share, 0.0))]
                if fit:
                    own = word_fits(words, uniq, m)[inv, best[w.doc]] if langs else np.zeros(len(w.doc))
                    out.append(pa.array(np.bincount(w.doc, own, w.n_docs) / np.maximum(w.counts(), 1)))
                yield pa.RecordBatch.from_arrays([b.column(k)[i:j] for k in range(len(names))] + out, [f"c{k}" for k in range(len(names))] + added)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"c{k} {kinds[c]}" for k, c in enumerate(names)] + ["lang_pred string", "score double", "fit double"][:len(added)])
    read = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(sent)])
    return read.mapInArrow(run, schema).toDF(*names, *added)


def op4_word_backoff(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = learn(docs.where("not held_out"))
    return predict(docs, model, ("doc_id", "held_out"))
