"""From raw documents to a training mix: five stages, each one of the corpus
operators applied to all that its predecessor kept.

``run`` writes every stage as Parquet in the shared checkpoint folder and reads
it again as the next stage's documents. All stages but the last return the
columns of the documents.

1. language: documents without a letter, without a language that holds
   ``MIN_LANGUAGE_SCORE`` of the vote, or whose words fit the one found worse than
   ``MIN_LANGUAGE_FIT`` (mean log ratio to independent letters), go.
2. near duplicates: one document of each class of similar texts stays.
3. passages: passages of 50 words or more that an earlier document has are cut
   out; a document that consisted of them goes.
4. benchmark: documents that hold a window of a benchmark item go.
5. mix: the kept documents in training order, one row per reading, with epoch,
   position and the number of tokens to read (``tokens``).

SQL can't express the stages (ORACLE_SQL is None); the tests compare ``run``
with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regilens.llm import decontaminate as leaks
from regilens.llm import langid, mixing, ngram_join, passages
from regilens.llm._spark import staged, table, text_key
from regilens.session import checkpoint_root

MIN_LANGUAGE_SCORE = 0.35
MIN_LANGUAGE_FIT = -4.0


def _only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Documents whose (doc_id, text) is (left_semi) or isn't (left_anti) among
    the written ``keys`` (doc_id, t)."""
    k = keys.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    return docs.withColumn("__key", text_key(F.col("text"))) \
        .join(k, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__t")), how).drop("__key")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.predict(docs, langid.learn(docs), tuple(docs.columns), fit=True).toDF(*docs.columns, "__lang", "__score", "__fit")
    return judged.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE_SCORE) & (F.col("__fit") >= MIN_LANGUAGE_FIT)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = ngram_join.near_duplicates(docs)
    gone = staged(judged.where("not stays").select("doc_id", "t").distinct(), "pipeline-copies")
    left = _only(docs, gone, "left_anti")
    # the row that stays may itself be repeated: those few rows are reduced to one each
    again = staged(judged.where("stays").groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t"), "pipeline-repeats")
    repeated = _only(left, again, "left_semi").withColumn("__key", text_key(F.col("text"))).dropDuplicates(["doc_id", "__key"])
    return _only(left, again, "left_anti").unionByName(repeated.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.cut_passages(docs, passages.repeated_passages(docs)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, staged(judged.where("n_hit > 0").select("doc_id", "t"), "pipeline-leaks"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(mixing.curriculum(docs, keep=tuple(c for c in docs.columns if c.lower() not in mixing.RESULT)))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", repeated_passages),
          ("benchmark", benchmark), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = checkpoint_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"{root.rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
