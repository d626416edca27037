"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are made equally long by one more coordinate (so the largest inner
product is the smallest distance), projected to a few random dimensions,
shifted, and ordered along a Hilbert curve; each of ``CURVES`` curves has its
own projection and shift. Spark range-partitions and sorts all (curve, key)
rows; a row's rank is its partition's offset plus its place there. A query
meets, on each curve, all rows within ``window`` ranks; the candidates of all
curves are merged and reranked by the exact inner product.

``window`` is fitted: for at most ``sample`` queries the true neighbours are
found by one exhaustive pass, and the window is the quantile ``target`` of the
neighbours' rank distance on their best curve. That sample is the only bound;
every row is indexed and every query searched. Data without structure (uniform
directions in many dimensions) need windows of several percent of the rows:
that is what the recall costs there, see the README.

Equal vectors are indexed once, with their 21 smallest ids (more can't appear
among 20 neighbours), found with a group limit on the map side, so a vector
that a third of the rows share isn't a large group anywhere. Rows of a curve
are dealt in blocks of at most ``MAX_BLOCK``, queries go to the blocks that
their window touches.

Edge cases: vectors that are NULL, empty, zero, hold NULL or non-finite
components, or aren't of the most frequent length take no part, nor do NULL
ids; equal rows count once; rows that share an id but not the vector are
queries and candidates of their own, never each other's candidates; ties go to
the smaller id; fewer candidates than ``k`` give all; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import staged, table
from ._text import list_array

CURVES = 8
DIMS = 4
BITS = 10
MAX_BLOCK = 8192
MIN_BLOCK = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cell coordinates: the
    coordinates are untangled from the most significant bit down (exchange or
    invert the lower bits), Gray-decoded, and their bits interleaved."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(x)):
            on = (x[i] & bit) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ swap ^ np.where(on, low, np.uint64(0))
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & one > 0, (one << np.uint64(level)) - one, np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for part in x:
            key = (key << one) | (((part ^ flip) >> np.uint64(level)) & one)
    return key


def curve_keys(vectors: np.ndarray, longest: float, curves: int = CURVES, seed: int = 11) -> np.ndarray:
    """One row of keys per vector: its place along every curve."""
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(1), 0))[:, None]
    full = np.hstack([vectors, rest]) / max(longest, 1e-300)
    rng = np.random.default_rng(seed)
    out = np.empty((len(full), curves), np.uint64)
    for c in range(curves):
        dims = min(DIMS, full.shape[1])
        basis = np.linalg.qr(rng.normal(size=(full.shape[1], dims)))[0]
        shift = rng.random(dims)
        spread = full @ basis * np.sqrt(full.shape[1])  # about unit variance for even directions
        cell = ((1 / (1 + np.exp(-1.7 * spread)) + shift) / 2 * (1 << BITS)).astype(np.int64)
        out[:, c] = hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1), BITS)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, with the vector in double precision."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = ok.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return ok.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(vid, v, ids, query): each distinct vector with its k + 1 smallest ids;
    vid is the smallest, query tells whether any of its rows is one."""
    marked = rows.withColumn("query", is_query).withColumn("h", F.xxhash64("v"))
    few = marked.withColumn("_r", F.row_number().over(W.partitionBy("h", "v", "query").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    return few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("query").alias("query")) \
        .select(F.xxhash64("h", F.element_at("ids", 1)).alias("vid"), "v", "ids", "query")


def _best(queries: np.ndarray, base: np.ndarray, base_id: np.ndarray, first_id: np.ndarray, keep: int):
    """For each query (row, ids, exact scores) of the ``keep`` best base rows,
    ties to the smaller first id."""
    approx = queries @ base.T
    slack = 1e-9 * (np.abs(approx).max(initial=0) + 1)
    for r in range(len(queries)):
        a = approx[r]
        at = np.flatnonzero(a >= np.partition(a, len(a) - keep)[len(a) - keep] - slack) if len(a) > keep else np.arange(len(a))
        exact = (base[at] * queries[r]).sum(1)  # one order of additions wherever the pair meets
        order = np.lexsort((first_id[at], -exact))[:keep]
        yield r, base_id[at[order]], exact[order]


def fit_window(vecs: DataFrame, order: DataFrame, k: int, target: float, sample: int) -> int:
    """The rank distance within which ``target`` of the sampled queries' true
    neighbours lie on their best curve."""
    picked = vecs.where("query").orderBy(F.xxhash64("vid"), "vid").limit(sample).select("vid", "v").collect()
    if not picked:
        return 1
    spark = vecs.sparkSession
    shared = spark.sparkContext.broadcast(([r["vid"] for r in picked], np.array([r["v"] for r in picked])))

    def run(batches):
        names, q = shared.value
        for b in batches:
            if b.num_rows:
                first = np.array([x[0] for x in b.column(2).to_pylist()], np.int64)
                for r, ids, scores in _best(q, _matrix(b.column(1)), b.column(0).to_numpy(), first, k + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), names[r])), pa.array(ids), pa.array(scores)], ["q", "vid", "s"])
    near = vecs.select("vid", "v", "ids").mapInArrow(run, "q long, vid long, s double")
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "vid"))).where((F.col("_r") <= k + 1) & (F.col("q") != F.col("vid")))
    near = staged(near.select("q", "vid"), "curve-sample")
    own = order.join(near.select(F.col("q").alias("vid")).distinct(), "vid").select(F.col("vid").alias("q"), "curve", F.col("rank").alias("r1"))
    far = order.join(near, "vid").join(own, ["q", "curve"]).groupBy("q", "vid").agg(F.min(F.abs(F.col("rank") - F.col("r1"))).alias("d"))
    found = far.agg(F.percentile("d", F.lit(target)).alias("w")).first()["w"]
    return max(1, int(np.ceil(found or 1)))


def ordered(vecs: DataFrame, curves: int) -> DataFrame:
    """(curve, vid, query, rank): all rows of all curves, ranked along them."""
    longest = vecs.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys, n = curve_keys(_matrix(b.column(1)), longest, curves), b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(curves, dtype=np.int32), n)), pa.array(keys.ravel().view(np.int64)),
                                                  pa.array(np.repeat(b.column(0).to_numpy(), curves)),
                                                  pa.array(np.repeat(b.column(2).to_numpy(zero_copy_only=False), curves))], ["curve", "key", "vid", "query"])
    keyed = vecs.select("vid", "v", "query").mapInArrow(run, "curve int, key long, vid long, query boolean")
    parts = max(1, int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(keyed.repartitionByRange(parts, "curve", "key", "vid").sortWithinPartitions("curve", "key", "vid")
                   .select("curve", "vid", "query", F.monotonically_increasing_id().alias("at")), "curve-order")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    offsets = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("part", part).join(offsets, "part") \
        .select("curve", "vid", "query", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    # every curve has all vectors: its ranks start after the curves before it
    return placed.select("curve", "vid", "query", (F.col("place") - F.col("curve") * F.lit(vecs.count())).alias("rank"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, target: float = 0.95, sample: int = 200,
           window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows found."""
    rows = usable(vectors)
    vecs = staged(distinct_vectors(rows, is_query, k), "curve-vectors")
    order = staged(ordered(vecs, curves), "curve-ranks")
    window = window or fit_window(vecs, order, k, target, sample)
    block = min(max(window, MIN_BLOCK), MAX_BLOCK)
    placed = order.join(vecs.select("vid", "v", F.element_at("ids", 1).alias("first")), "vid")
    on = F.shiftleft(F.col("curve").cast("bigint"), 48)  # blocks don't reach from one curve into the next
    base = placed.select((on + F.expr(f"rank div {block}")).alias("block"), F.lit(0).alias("role"), "vid", "first", "v")
    asks = placed.where("query").select(on.alias("on"), F.explode(F.sequence(F.expr(f"greatest(rank - {window}, 0) div {block}"), F.expr(f"(rank + {window}) div {block}"))).alias("b"),
                                        "vid", "first", "v").select((F.col("on") + F.col("b")).alias("block"), F.lit(1).alias("role"), "vid", "first", "v")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.unionByName(asks).repartition(parts, "block").sortWithinPartitions("block", "role")

    def run(batches):
        current, held = None, []
        for b in batches:
            blocks, roles = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(blocks)]):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                if blocks[i] != current:
                    current, held = blocks[i], []
                ids, v = part.column(2).to_numpy(), _matrix(part.column(4))
                if roles[i] == 0:
                    held.append((ids, part.column(3).to_numpy(), v))
                    continue
                if not held:
                    continue  # a block past the last row
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                names, first, m = held[0]
                found = list(_best(v, m, names, first, k + 1))
                n = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x[1] for x in found])),
                                                  pa.array(np.concatenate([x[2] for x in found]))], ["q", "vid", "score"])
    pairs = dealt.mapInArrow(run, "q long, vid long, score double").groupBy("q", "vid").agg(F.max("score").alias("score"))
    ids = pairs.join(vecs.select("vid", "ids"), "vid").select("q", "score", F.explode("ids").alias("vec_id"))
    by = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = ids.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1) \
        .groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), "vec_id", "score"))).alias("near"))
    # every query row gets its vector's list without itself
    asked = rows.where(is_query).distinct().withColumn("h", F.xxhash64("v"))
    vid_of = vecs.where("query").select("vid", "v", F.xxhash64("v").alias("h"))
    named = asked.join(vid_of, ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("vid").alias("q"))
    return named.join(lists, "q") \
        .select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near")) \
        .select("query_id", F.posexplode("near").alias("rank", "n")) \
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op7_hilbert_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
