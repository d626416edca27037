"""Groups of spelling variants: words one edit apart, joined by asymmetric
q-chunks.

1. Words are counted where they stand: the runs of letters of every text, summed
   on the map side, so a frequent word is one row per task.
2. Of two words one edit apart, the shorter (r, of L code points; of equal ones
   the smaller) gives its two disjoint chunks, its first and last L div 2 code
   points. One edit spoils at most one of them; the other is a gram of the
   longer word (s), standing where it stood in r or, if s is longer by one, at
   most one place later. So s gives its positional grams within that shift of a
   chunk's place (the others can't meet a chunk), for either length of r.
3. Chunks and grams meet in a join on (L, chunk, text). A key that many words
   share on both sides isn't paired: what is left of its words beside the chunk
   is again one edit apart, so both sides are cut into chunks and grams again
   and the key grows by half of the rest, until one code point is left. A key
   is joined only where one side has at most ``width`` rows.
4. The pairs that meet are verified by their edit distance.
5. A word's form is its most frequent near word, if frequent enough; the root is
   found by doubling the steps along the forms (counts at least double at every
   step, so a chain is short and has no loop).

Only DataFrame functions are used. Words, keys and pairs stay in tables; the
driver sees whether a round is left, nothing else.

Edge cases: a NULL text has no words; a NULL doc_id deletes nothing; repeated
rows count each for itself; equal counts give the smaller form in code-point
order; a run without a near word keeps itself as root; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ascii_lower, skewed_join, staged, table

#: Runs of letters once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
WIDTH = 64


def typed_runs(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """(word): every run of letters of the texts. With ``drop_every``, a run
    whose crc32 together with the doc_id it divides loses one code point."""
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    if not drop_every:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.char_length("run")))
    return runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(runs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return runs.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _piece(rest: Column, start: Column, size: Column) -> Column:
    return F.substring(rest, start + 1, size)


def _without(rest: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), start), F.substring(rest, start + size + 1, F.char_length(rest)))


def _keyed(rows: DataFrame, length: Column, starts: list[tuple[int, Column]], keep: list[str]) -> DataFrame:
    """One row per (chunk number, place): the key of the piece there and the
    rest. ``length`` is the chunked word's, ``starts`` are places in ``rest``."""
    size = F.expr("__l div 2").cast("int")
    places = F.array(*[F.struct(F.lit(i).alias("i"), at.cast("int").alias("at")) for i, at in starts])
    cut = rows.withColumn("__l", length).where("__l >= 2").withColumn("__q", size).withColumn("__p", F.explode(places))
    at = F.col("__p.at")
    return cut.select(*keep, F.xxhash64("key", "__l", "__p.i", _piece(F.col("rest"), at, F.col("__q"))).alias("key"),
                      _without(F.col("rest"), at, F.col("__q")).alias("rest"))


def chunks(rows: DataFrame) -> DataFrame:
    """(word, key, rest): the first and the last half of what is left of each word."""
    size = F.char_length("rest")
    return _keyed(rows, size, [(0, F.lit(0)), (1, size - F.col("__q"))], ["word"])


def grams(rows: DataFrame) -> DataFrame:
    """(word, longer, key, rest): the grams that a chunk of a word shorter by
    ``longer`` code points may meet, at its place or at most ``longer`` later."""
    size = F.char_length("rest") - F.col("longer")
    out = [_keyed(rows.where(F.col("longer") == d), size, [(i, at + s) for i, at in ((0, F.lit(0)), (1, F.col("__l") - F.col("__q"))) for s in range(d + 1)],
                  ["word", "longer"]) for d in (0, 1)]
    return out[0].unionByName(out[1]).distinct()  # "aaa" has its gram twice


def near_pairs(words: DataFrame, width: int = WIDTH) -> DataFrame:
    """(u, v): the pairs of words exactly one edit apart, each once."""
    first = words.select("word", F.lit(0).cast("bigint").alias("key"), F.col("word").alias("rest"))
    short, long = chunks(first), grams(first.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))))
    found = None
    while True:
        short, long = staged(short, "spelling-chunks"), staged(long, "spelling-grams")
        many = short.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > width).select("key") \
            .join(long.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > width).select("key"), "key")
        # one code point left can't be cut: such a key has few words by itself
        hot = staged(many.join(short.where(F.char_length("rest") >= 2).select("key"), "key", "left_semi"), "spelling-hot")
        left = hot.limit(1).count() > 0
        s, g = (short.join(hot, "key", "left_anti"), long.join(hot, "key", "left_anti")) if left else (short, long)
        met = s.select("key", F.col("word").alias("u")).join(g.select("key", F.col("word").alias("v"), "longer"), "key") \
            .where(((F.col("longer") == 1) | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)).select("u", "v").distinct()
        pairs = staged(met, "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if not left:
            return found.distinct()
        short, long = chunks(short.join(hot, "key", "left_semi")), grams(long.join(hot, "key", "left_semi"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the forms lead to."""
    out = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(skewed_join(out, step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "spelling-roots")
        out = moved.select("word", "root")
        if not moved.where("on").limit(1).count():
            return out


def variants(words: DataFrame, ratio: int = RATIO, width: int = WIDTH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words (word, n)."""
    words = staged(words, "spelling-words")
    pairs = staged(near_pairs(words, width), "spelling-near")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counts = words.select(F.col("word").alias("v"), F.col("n").alias("m"))
    best = both.join(counts, "v").groupBy("u").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "v")).alias("b"))
    judged = words.join(best.withColumnRenamed("u", "word"), "word", "left")
    enough = -F.col("b.m") >= ratio * F.col("n")
    told = staged(judged.select("word", F.when(enough, F.col("b.v")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                F.when(enough, -F.col("b.m")).alias("form_n")), "spelling-forms")
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_chunks(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(typed_runs(table(spark, sf_dir, "documents"), drop_every=97)))
