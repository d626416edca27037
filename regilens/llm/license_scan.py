"""License scan by diagonal voting.

All rolling word 2-gram hashes of a text are joined to the positions of the
same 2-grams in the license templates. A hit at text position p and template
position q votes for the diagonal p - q, the place where the template would
start. Votes are summed by (document, template, diagonal); the words of a hit
are compared, not only their hashes, so a diagonal that holds every 2-gram of
its template is an exact occurrence. Neighbouring diagonals (a word inserted
shifts the rest of the template to a larger diagonal, a lost one to a smaller)
are merged in the order of the text into one span, which is verified: enough of the template's 2-grams, in a span not much longer than it.

The template table is a parameter of fixed size (TEMPLATES: under 400 2-grams,
a few KB), the only thing that is broadcast; the words of the corpus never
move, only hits are shuffled, by document and template, so no key holds more
than one text's hits. Only DataFrame functions.

Edge cases: a NULL or empty text has no words: zero counts, empty labels,
score 0; rows that repeat a doc_id are told apart by their text, equal rows get
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import ascii_lower, staged, table, text_key

#: Phrases whose exact places are counted: label -> words. Fixed values.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Notices found approximately: label -> words. Public license texts.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                   "without warranties or conditions of any kind either express or implied"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
            "merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: What stands between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_COVER = 0.75
MAX_STRETCH = 1.3
SLACK = 2


def words_of(text: Column) -> Column:
    """The words between separators; a split is far cheaper than matching each word."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_grams(spark, base=BASE, templates=TEMPLATES) -> DataFrame:
    rows = []
    for i, (label, phrase) in enumerate([*base, *templates]):
        ws = phrase.split(" ")
        rows += [(i, label, i < len(base), len(ws) - 1, q, a, b) for q, (a, b) in enumerate(zip(ws, ws[1:]))]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, q int, a string, b string")
    return t.withColumn("h", F.xxhash64("a", "b"))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: doc_id, _t, n_words for every row; spans:
    doc_id, _t, label, base, start, words (length in words), cover (0 to 1) of
    every exact place of a base phrase and every verified template span."""
    spark = docs.sparkSession
    read = docs.select("doc_id", text_key(F.col("text")).alias("_t"), words_of(F.col("text")).alias("w"))
    counted = docs.select("doc_id", text_key(F.col("text")).alias("_t"),
                          F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    pairs = read.select("doc_id", "_t", F.posexplode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("x"),
                                                                  F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("y"))).alias("p", "g")) \
        .select("doc_id", "_t", "p", F.col("g.x").alias("x"), F.col("g.y").alias("y"), F.xxhash64("g.x", "g.y").alias("h"))
    grams = template_grams(spark, base, templates)
    hits = pairs.join(F.broadcast(grams), "h").where("x = a and y = b") \
        .select("doc_id", "_t", "template", "label", "base", "grams", "q", "p", (F.col("p") - F.col("q")).alias("diagonal"))
    # equal rows (same doc_id and text) vote together: count distinct template positions, not rows
    diagonals = staged(hits.groupBy("doc_id", "_t", "template", "label", "base", "grams", "diagonal").agg(
        F.collect_set("q").alias("qs"), F.min("p").alias("from"), F.max("p").alias("to")), "license-diagonals")
    by = W.partitionBy("doc_id", "_t", "template").orderBy("from", "diagonal")
    exact = diagonals.where(F.col("base") & (F.size("qs") == F.col("grams"))) \
        .select("doc_id", "_t", "label", "base", F.col("diagonal").alias("start"), (F.col("grams") + 1).alias("words"), F.lit(1.0).alias("cover"))
    # a diagonal joins the one before it in the text if it lies within the slack, to
    # either side, and its template positions carry on behind the other's
    breaks = (F.coalesce(F.abs(F.col("diagonal") - F.lag("diagonal").over(by)), F.lit(SLACK + 1)) > SLACK) \
        | (F.array_min("qs") <= F.lag(F.array_max("qs")).over(by))
    merged = diagonals.where(~F.col("base")) \
        .withColumn("_cut", F.coalesce(breaks, F.lit(True)).cast("int")) \
        .withColumn("_span", F.sum("_cut").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))) \
        .groupBy("doc_id", "_t", "template", "label", "base", "grams", "_span") \
        .agg(F.sum(F.size("qs")).alias("votes"), F.min("from").alias("from"), F.max("to").alias("to"))
    spans = merged.withColumn("words", F.col("to") - F.col("from") + 2).withColumn("cover", F.col("votes") / F.col("grams")) \
        .where((F.col("cover") >= MIN_COVER) & (F.col("words") <= MAX_STRETCH * (F.col("grams") + 1))) \
        .select("doc_id", "_t", "label", "base", F.col("from").alias("start"), "words", "cover")
    return counted, exact.unionByName(spans)


def op2_license_diagonals(spark, sf_dir: str) -> DataFrame:
    counted, spans = scan(table(spark, sf_dir, "documents"))
    per = spans.groupBy("doc_id", "_t").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score")) \
        .withColumnRenamed("doc_id", "_d").withColumnRenamed("_t", "_k")
    return counted.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_t").eqNullSafe(F.col("_k")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _oracle() -> str:
    rows = ",".join(f"({i}, '{label}', {str(i < len(BASE)).lower()}, '{phrase}')" for i, (label, phrase) in enumerate([*BASE, *TEMPLATES]))
    return r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t0(template, label, base, phrase) AS (VALUES """ + rows + r"""),
t AS (SELECT template, label, base, len(ws) - 1 AS grams, q, ws[q + 1] AS a, ws[q + 2] AS b
  FROM (SELECT *, string_split(phrase, ' ') AS ws FROM t0), LATERAL (SELECT unnest(range(len(ws) - 1)) AS q)),
g AS (SELECT k, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT k, w, unnest(range(len(w) - 1)) AS p FROM d WHERE len(w) > 1)),
v AS MATERIALIZED (SELECT k, template, label, base, grams, p - q AS diagonal, count(*) AS votes, min(q) AS q0, max(q) AS q1, min(p) AS p0, max(p) AS p1
  FROM g JOIN t USING (a, b) GROUP BY ALL),
m AS (SELECT *, sum(cut) OVER (PARTITION BY k, template ORDER BY p0, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM (
  SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= """ + str(SLACK) + r""" AND q0 > lag(q1) OVER o THEN 0 ELSE 1 END AS cut
  FROM v WHERE NOT base WINDOW o AS (PARTITION BY k, template ORDER BY p0, diagonal))),
s AS (
  SELECT k, label, true AS base, diagonal AS start, 1.0::DOUBLE AS cover FROM v WHERE base AND votes = grams
  UNION ALL
  SELECT k, label, false, min(p0), sum(votes)::DOUBLE / grams FROM m GROUP BY k, template, label, grams, span
  HAVING sum(votes)::DOUBLE / grams >= """ + str(MIN_COVER) + " AND max(p1) - min(p0) + 2 <= " + str(MAX_STRETCH) + r""" * (grams + 1)),
r AS (SELECT k, count(*) FILTER (base) AS n, min(start) FILTER (base) AS f, max(start) FILTER (base) AS l,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(cover) AS c FROM s GROUP BY k)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(c, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (k)
"""


ORACLE = _oracle()
