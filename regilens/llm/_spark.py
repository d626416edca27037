"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regilens.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java / RE2 pattern of the word class used by the scans: ASCII letters and digits
#: (after lower-casing A-Z) and every non-ASCII character.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pattern of white-space separated tokens.
TOKEN = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_remainder(c: Column, mod: int) -> Column:
    """crc32 of a value's text, modulo ``mod`` (NULL for NULL)."""
    return F.crc32(c.cast("string").cast("binary")) % mod


def text_key(c: Column) -> Column:
    """Tells apart rows that carry the same doc_id but different texts."""
    return F.xxhash64(c)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of re-running
    the chain) and gives the optimiser the true size, so small tables are
    broadcast by the session's own threshold and large ones are not. The shuffle
    files of the write go as soon as it ends: nothing reads them again, and they
    would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/regilens_llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hash_bitmap(df: DataFrame, column: str, bits: int = 23):
    """A bitmap of 2^bits slots (1 MB for 23) that marks each value's hash: of
    fixed size whatever the number of values, so it may go to every task. It
    lets all marked values through and few others; an exact join follows."""
    import numpy as np
    slot = (F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1).cast("bigint")
    rows = df.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()  # at most 2^bits / 32768 rows of 4 KB
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        part = np.frombuffer(r["m"], np.uint8)
        out[(r["b"] - 1) * 4096:(r["b"] - 1) * 4096 + len(part)] = part
    return df.sparkSession.sparkContext.broadcast(out)


def marked(bitmap, hashes, bits: int = 23):
    """Which of the uint64 hashes a bitmap's array marks."""
    import numpy as np
    slot = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a never-NULL key whose rows on the left may be many, to a right
    side that is an aggregate by that key. The key is wrapped in a struct, so
    the right side is exchanged anew and the skew join can split a hot key;
    fed by the aggregate directly, it never would."""
    r = right.withColumnRenamed(key, "__key")
    return left.join(r, F.struct(F.col(key).alias("k")) == F.struct(F.col("__key").alias("k")), how).drop("__key")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v): connected
    components. Each round every node moves to its smallest neighbour (or
    stays), edges between merged nodes vanish and the rest is relabelled; with
    hashed ids some constant share of nodes goes per round. Tables are written
    each round; only the number of edges left reaches the driver."""
    both = edges.where("u <> v").select("u", "v")
    left = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    roots = None
    while left.limit(1).count():
        step = staged(left.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("was"), F.least("u", "low").alias("now")), f"{name}-step")
        if roots is None:  # every node has an edge at first
            roots = step.select(F.col("was").alias("node"), F.col("now").alias("root"))
        else:
            roots = staged(roots.join(step, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")), f"{name}-roots")
        moved = left.join(step, F.col("u") == F.col("was")).select(F.col("now").alias("u"), "v") \
            .join(step, F.col("v") == F.col("was")).select("u", F.col("now").alias("v"))
        left = staged(moved.where("u <> v").distinct(), f"{name}-edges")
    return left.select(F.col("u").alias("node"), F.col("v").alias("root")) if roots is None else roots  # none: no edges


def marked_texts(docs: DataFrame, keys: DataFrame, column: str, key: Column):
    """(doc_id, key, text) of the documents whose ``key`` a bitmap of the keys'
    ``column`` marks (4 MB whatever their number). What passes is joined to the
    keys with a merge hint by the callers: the same plan at every size, and
    only texts that are asked for are shuffled."""
    bits = 25
    bitmap = hash_bitmap(keys.where(F.col(column).isNotNull()), column, bits)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            keep = marked(bitmap.value, b.column(1).to_numpy().view(np.uint64), bits)
            if keep.any():
                yield b.filter(pa.array(keep))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", key.alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, text string")
