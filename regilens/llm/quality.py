"""Quality classifier by Bradley-Terry pairwise ranking.

A document's utility is linear in features of its whole text (symbol, case and
digit shares, repeated lines, words and 3-grams, word and line lengths). A good
and a bad document form a preference pair; the weights maximise the likelihood
sigmoid(u(good) - u(bad)), logistic loss on feature differences. The decision
threshold is the quantile of the training utilities at the bad documents'
share; scores are sigmoid(u - threshold) shifted so that the threshold scores
0.3.

Features come from one pass over the texts, without a shuffle. The labels are
joined to the features, not to the texts. The fit is on a sample of at most
``max_rows`` labelled rows (the smallest hashes of their doc_id) and
``max_pairs`` random pairs of them; this is the only bound, and it holds for
the fit alone.

Edge cases: a NULL text counts as empty, an empty text has all features 0 and
gets a score like any other; a NULL doc_id is not held out and has no label;
labels that are NULL or contradict each other aren't learned; without both
classes all scores are 0.5; rows that repeat a doc_id are scored each for
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_remainder, staged, table
from ._text import TOKENS, WORDS, Words, chunks, kgrams, list_array

THRESHOLD = 0.3
_B = np.arange(256)
_CLASSES = {
    "symbol": (_B > 32) & (_B < 127) & ~WORDS & ~np.isin(_B, [ord(x) for x in ".,;:?!'\"-()"]),
    "upper": (_B >= 65) & (_B <= 90), "lower": (_B >= 97) & (_B <= 122), "digit": (_B >= 48) & (_B <= 57),
    "point": np.isin(_B, [ord(x) for x in ".,;:?"]), "shout": _B == ord("!"), "other": _B >= 128,
}
_LINES = _B != 10
SHARES = ("symbol", "upper", "digit", "shout", "bare", "odd_end", "line_copies", "gram_copies", "top_word")
FEATURES = ("size", "word_length", "long_words", "points", "line_words", "variety", "other", *SHARES, *(f"{x}_capped" for x in SHARES))


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) if len(doc) else np.zeros(n)


def _copies(hashes: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text: weight of entries seen before in the same text, and the count
    of its most frequent entry."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    again = (~new).astype(float) if weight is None else weight[order] * ~new
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(h))))
    return _per_doc(again, d, n), most


def text_features(w: Words) -> np.ndarray:
    """One row of FEATURES per text of a chunk of tokens."""
    n, tokens, size = w.n_docs, w.counts(), np.diff(w.offsets)
    per_token, per_byte = np.maximum(tokens, 1), np.maximum(size, 1)
    sums = {}
    for name, marks in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(marks[w.data])])
        sums[name] = total[w.offsets[1:]] - total[w.offsets[:-1]]
        if name == "symbol":
            symbols = total
    word = np.concatenate([[0], np.cumsum(WORDS[w.data])])
    length = w.end - w.start
    bare = (word[w.end] == word[w.start]).astype(float)
    odd = ((symbols[w.end] - symbols[w.end - 1]) > 0) & (bare == 0) if len(w.end) else np.zeros(0, bool)
    repeated, most = _copies(w.hash, w.doc, n)
    at, grams = kgrams(w.hash, w.doc, 3)
    grams_again, _ = _copies(grams, w.doc[at], n)
    lines = Words(w.data, w.offsets, _LINES)
    line_size = (lines.end - lines.start).astype(float)
    lines_again, _ = _copies(lines.hash, lines.doc, n, line_size)
    distinct = tokens - repeated
    f = {
        "size": np.log1p(tokens), "word_length": size / per_token / 10, "long_words": _per_doc((length > 15).astype(float), w.doc, n) / per_token,
        "points": sums["point"] / per_token, "line_words": np.log1p(tokens / np.maximum(lines.counts(), 1)),
        "variety": np.log1p(distinct) / np.log1p(per_token), "other": sums["other"] / per_byte,
        "symbol": sums["symbol"] / per_byte, "upper": sums["upper"] / np.maximum(sums["upper"] + sums["lower"], 1), "digit": sums["digit"] / per_byte,
        "shout": sums["shout"] / per_token, "bare": _per_doc(bare, w.doc, n) / per_token, "odd_end": _per_doc(odd.astype(float), w.doc, n) / per_token,
        "line_copies": lines_again / per_byte, "gram_copies": grams_again / np.maximum(tokens - 2, 1), "top_word": most / per_token,
    }
    f["top_word"] = np.where(tokens >= 10, f["top_word"], 0)
    f |= {f"{x}_capped": np.minimum(1, 10 * f[x]) for x in SHARES}
    return np.stack([np.where(size > 0, f[x], 0.0) for x in FEATURES], 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""
    def run(batches):
        for b in batches:
            for i, j, w in chunks(b, "text", TOKENS):
                x = text_features(w)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], list_array(x.ravel(), np.full(w.n_docs, x.shape[1]), pa.float64())], ["doc_id", "x"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = 200_000, ridge: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) so that sigmoid(x @ weights + bias) is the score."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(len(FEATURES)), 0.0
    scale = x.std(0) + 1e-9
    z = x / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, max_pairs)] - z[rng.choice(bad, max_pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(15):  # Newton steps on the convex pair loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    cut = float(np.quantile(z @ w, len(bad) / len(y)))
    return w / scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def learn(scored: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled documents of ``scored`` (doc_id, x),
    picked by a hash of their doc_id; a repeated doc_id counts once."""
    clear = labels.where("quality is not null and doc_id is not null").groupBy("doc_id") \
        .agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2 and y in (0, 1)")
    # one row per labelled doc_id, whatever the number of rows that bear it
    labelled = staged(scored.join(clear.select("doc_id", "y"), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")), "quality-labelled")
    n, spread = labelled.count(), F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40))
    few = labelled if n <= max_rows else labelled.where(spread < int((max_rows + 6 * max_rows ** 0.5) / n * (1 << 40)))  # the sample leaves the tasks, nothing more
    sample = few.orderBy(spread, "doc_id").limit(max_rows).select("x", "y").toPandas()
    if not len(sample):
        return np.zeros(len(FEATURES)), 0.0
    return fit(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy())


def score(scored: DataFrame, model: tuple[np.ndarray, float]):
    """The score column of rows with features ``x``."""
    weights, bias = model
    u = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), u))))


def op8_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = staged(features(docs).withColumn("held_out", held), "quality-features")
    model = learn(scored.where("not held_out"), labels)
    out = scored.select("doc_id", "held_out", score(scored, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
