"""Hard negatives: for every anchor and each of its nearest rows of the same
label, the nearest rows of other labels that score clearly lower.

Scores are integer inner products. Most pairs are settled by short codes:

* A vector is rotated and replaced by the signs of its components, one bit each;
  with the code goes its alignment, the vector's inner product with its own code
  vector. What the code leaves over stands at right angles to the code vector;
  it is rotated anew and coded again, ``LAYERS`` times, and the length of the
  last rest is stored.
* An anchor's rotated components are cut to ``PLANES`` bits, kept as bit planes.
  Its inner product with a code vector is then a weighted sum of popcounts; what
  the cutting may change is at most the sum of the cut-off parts.
* The last rest adds, by Cauchy-Schwarz, at most its length times the length of
  the anchor's part at right angles to the last code vector. So every pair has a
  sure interval around its estimate, and only pairs whose interval can reach the
  result are scored exactly: it must reach the k-th largest sure lower end (of
  those surely within the allowed scores), and the allowed scores themselves.

Equal vectors of one label are one row with their ``KEEP`` smallest ids (more
can't appear), found with a group limit on the map side. Anchors and rows are
dealt in blocks; a task meets one block of each and gives the best few per
anchor, which a window merges. Positives meet within blocks of one label, whose
number follows the label's size, so a label may hold any share of the rows. The
driver sees row counts and the vectors' length only.

Edge cases: rows with a NULL id or label take no part, nor do vectors that are
NULL or hold NULL, non-finite components or ones beyond +-2^14 (their products
would leave 64 bits), nor vectors not of the most frequent length (the longer
of equally frequent ones); zero vectors take part; equal rows count once; rows
that share an id but not label or vector are rows of their own, never each
other's positives or negatives; ties go to the smaller id; a positive whose
score is below zero has no negatives; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spark import skewed_join, staged, table
from ._text import list_array, runs

LAYERS = 6
PLANES = 6
POSITIVES = 5
NEGATIVES = 3
KEEP = 6
LARGEST = 1 << 14
ANCHOR_BLOCK = 4096
ROW_BLOCK = 2048
AT_ONCE = 256


@lru_cache(maxsize=16)
def rotation(size: int, layer: int) -> np.ndarray:
    """The same random rotation in every task."""
    return np.linalg.qr(np.random.default_rng([17, size, layer]).normal(size=(size, size)))[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words from rows of bits."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def codes(vectors: np.ndarray, layers: int = LAYERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits by row, layer and word; alignment by row and layer; length of the rest)."""
    n, d = vectors.shape
    rest = vectors.astype(np.float64)
    bits, aligned = [], np.zeros((n, layers))
    for x in range(layers):
        turned = rest @ rotation(d, x)
        sign = turned >= 0
        bits.append(_packed(sign))
        aligned[:, x] = np.abs(turned).sum(1) / np.sqrt(d)
        turned -= np.where(sign, 1.0, -1.0) * (aligned[:, x] / np.sqrt(d))[:, None]
        rest = turned @ rotation(d, x).T
    return np.stack(bits, 1), aligned, np.sqrt((rest ** 2).sum(1))


def intervals(anchors: np.ndarray, bits: np.ndarray, aligned: np.ndarray, rest: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of every anchor's inner product with every coded row."""
    q = anchors.astype(np.float64)
    (a, d), (n, layers) = q.shape, aligned.shape
    root = np.sqrt(d)
    estimate, wide = np.zeros((a, n)), np.zeros((a, n))
    along = np.zeros((a, n))
    for x in range(layers):
        turned = q @ rotation(d, x)
        low = turned.min(1)
        step = np.maximum(turned.max(1) - low, 1e-300) / ((1 << planes) - 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        cut = np.abs(turned - low[:, None] - step[:, None] * level).sum(1) / root
        votes = np.zeros((a, n), np.int32)
        for p in range(planes):
            plane = _packed(((level >> p) & 1).astype(np.uint8))
            for w in range(bits.shape[2]):
                votes += np.bitwise_count(bits[None, :, x, w] & plane[:, None, w]).astype(np.int32) << p
        ones = np.bitwise_count(bits[:, x]).sum(1, dtype=np.int64)
        inner = (low[:, None] * (2 * ones - d)[None, :] + step[:, None] * (2.0 * votes - level.sum(1)[:, None])) / root
        estimate += aligned[:, x][None, :] * inner
        wide += aligned[:, x][None, :] * cut[:, None]
        along = np.maximum(np.abs(inner) - cut[:, None], 0)  # the last code vector's sure share of the anchor
    lengths = (q ** 2).sum(1)
    wide += rest[None, :] * np.sqrt(np.maximum(lengths[:, None] - along ** 2, 0))
    wide += 1e-9 * (np.sqrt(lengths)[:, None] * (aligned.sum(1) + rest)[None, :] + 1)  # rounding
    return estimate - wide, estimate + wide


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each once, v in integers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = vectors.select("vec_id", label.cast("bigint").alias("label"), v.alias("e")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & fine)
    out = staged(rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * 256)).alias("v")).distinct(), "negatives-rows")
    size = out.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()  # one row
    return out.where(F.size("v") == (size[0]["d"] if size else 0))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(len(column), -1) if len(column) else np.zeros((0, 0)), dtype=kind)


def coded(rows: DataFrame) -> DataFrame:
    """(cid, label, v, ids, bits, aligned, rest): one row per vector and label."""
    hashed = rows.withColumn("h", F.xxhash64("label", "v"))
    by = W.partitionBy("h", "label", "v").orderBy("vec_id")
    few = hashed.withColumn("r", F.row_number().over(by)).where(F.col("r") <= KEEP)
    classes = few.groupBy("h", "label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                bits, aligned, rest = codes(_matrix(b.column(2), np.float64))
                each = np.full(n, bits.shape[1] * bits.shape[2])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), list_array(bits.ravel().view(np.int64), each, pa.int64()),
                                                  list_array(aligned.ravel(), np.full(n, LAYERS), pa.float64()), pa.array(rest)],
                                                 ["cid", "label", "v", "ids", "bits", "aligned", "rest"])
    return classes.select(F.monotonically_increasing_id().alias("cid"), "label", "v", "ids") \
        .mapInArrow(run, "cid long, label long, v array<long>, ids array<long>, bits array<long>, aligned array<double>, rest double")


def _best(at: np.ndarray, col: np.ndarray, score: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    """Which entries are among the ``keep`` best of their anchor, ties to the smaller id."""
    order = np.lexsort((first, -score, at))
    a = at[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return order[rank < keep]


class _Rows:
    """One block's coded rows, and for each anchor those that hold its own id."""

    def __init__(self, part: pa.RecordBatch):
        self.v = _matrix(part.column("v"), np.int64)
        n = len(self.v)
        self.label = part.column("label").to_numpy()
        self.aligned, self.rest = _matrix(part.column("aligned"), np.float64), part.column("rest").to_numpy()
        self.bits = _matrix(part.column("bits"), np.int64).view(np.uint64).reshape(n, self.aligned.shape[1], -1)
        column = part.column("ids")
        off = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
        size = np.diff(off)
        of = np.repeat(np.arange(n), size)
        self.ids = np.full((n, KEEP + 1), np.iinfo(np.int64).max)
        self.ids[of, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
        order = np.argsort(flat, kind="stable")
        self._flat, self._of = flat[order], of[order]

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) where the row holds the anchor's id."""
        i, j = np.searchsorted(self._flat, ids), np.searchsorted(self._flat, ids, side="right")
        at = np.repeat(np.arange(len(ids)), j - i)
        return at, self._of[np.repeat(i, j - i) + np.arange(len(at)) - np.repeat(np.cumsum(j - i) - (j - i), j - i)]

    def first(self, at: np.ndarray, col: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The smallest id of each row that isn't the anchor's."""
        return np.where(self.ids[col, 0] == ids[at], self.ids[col, 1], self.ids[col, 0])

    def score(self, q: np.ndarray, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            out[i:i + (1 << 16)] = (q[at[i:i + (1 << 16)]] * self.v[col[i:i + (1 << 16)]]).sum(1)
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line (-inf if there are fewer)."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


UNIT = "unit long, role int, aid long, acid long, label long, v array<long>, ids array<long>, bits array<long>, aligned array<double>, rest double, asks array<long>"


def _anchor_columns(asks: Column):
    none = lambda kind: F.lit(None).cast(kind)
    return [F.lit(0).alias("role"), "aid", "acid", "label", "v", none("array<bigint>").alias("ids"), none("array<bigint>").alias("bits"),
            none("array<double>").alias("aligned"), none("double").alias("rest"), asks.alias("asks")]


def _row_columns():
    none = lambda kind: F.lit(None).cast(kind)
    return [F.lit(1).alias("role"), none("bigint").alias("aid"), none("bigint").alias("acid"), "label", "v", "ids", "bits", "aligned", "rest", none("array<bigint>").alias("asks")]


def _blocks(batches):
    """(anchors, coded rows) of every unit that has both."""
    for b in runs(batches):
        role = b.column(1).to_numpy()
        a = int((role == 0).sum())
        if 0 < a < len(role):
            yield b.slice(0, a), _Rows(b.slice(a))


def _emit(found, ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
    size = (ids < np.iinfo(np.int64).max).sum(1)
    flat = ids[np.arange(ids.shape[1])[None, :] < size[:, None]]
    return pa.RecordBatch.from_arrays([*[pa.array(x) for x in found], list_array(flat, size, pa.int64())], names)


def _dealt(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return anchors.unionByName(rows).select(*[c.split()[0] for c in UNIT.split(", ")]).repartition(parts, "unit").sortWithinPartitions("unit", "role")


def _count(rows: DataFrame, block: int, name: str) -> Column:
    return F.greatest(F.ceil(F.col(name) / block), F.lit(1)).cast("int")


def positives(anchors: DataFrame, rows: DataFrame, keep: int = POSITIVES) -> DataFrame:
    """(aid, acid, vec_id, score): each anchor's best other rows of its label."""
    sizes = staged(rows.groupBy("label").agg(F.count("*").alias("n")).join(anchors.groupBy("label").agg(F.count("*").alias("a")), "label")
                   .select("label", _count(rows, ROW_BLOCK, "n").alias("nb"), _count(rows, ANCHOR_BLOCK, "a").alias("na")), "negatives-labels")
    own = lambda *of: F.pmod(F.xxhash64(*of), F.col("nb" if of[0] == "cid" else "na"))
    asks = skewed_join(anchors, sizes, "label").withColumn("x", own("aid", "acid")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    base = skewed_join(rows, sizes, "label").withColumn("y", own("cid")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    unit = F.xxhash64("label", F.col("x").cast("bigint"), F.col("y").cast("bigint")).alias("unit")

    def run(batches):
        for asked, held in _blocks(batches):
            q_all, ids_all = _matrix(asked.column("v"), np.int64), asked.column("aid").to_numpy()
            classes, label = asked.column("acid").to_numpy(), asked.column("label").to_numpy()
            for i in range(0, len(q_all), AT_ONCE):
                q, ids = q_all[i:i + AT_ONCE], ids_all[i:i + AT_ONCE]
                lower, upper = intervals(q, held.bits, held.aligned, held.rest)
                other = label[i:i + AT_ONCE][:, None] != held.label[None, :]  # two labels whose unit hashes agree
                lower[other] = upper[other] = -np.inf
                a, c = held.own(ids)
                alone = held.ids[c, 1] == np.iinfo(np.int64).max
                lower[a[alone], c[alone]] = upper[a[alone], c[alone]] = -np.inf
                at, col = np.nonzero((upper >= _kth(lower, keep)[:, None]) & (upper > -np.inf))
                score = held.score(q, at, col)
                top = _best(at, col, score, held.first(at, col, ids), keep)
                yield _emit([ids[at[top]], classes[i:i + AT_ONCE][at[top]], score[top]], held.ids[col[top], :KEEP], ["aid", "acid", "score", "ids"])
    best = _dealt(asks.select(unit, *_anchor_columns(F.lit(None).cast("array<bigint>"))), base.select(unit, *_row_columns())) \
        .mapInArrow(run, "aid long, acid long, score long, ids array<long>")
    return _ranked(best, ["aid", "acid"], keep)


def _ranked(best: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The best ids of each anchor over all units, but its own, with their rank."""
    each = best.select(*by, "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("aid"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= keep)


def negatives(anchors: DataFrame, rows: DataFrame, wanted: DataFrame, keep: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """(aid, acid, ask, score, vec_id, rank): for each positive score ``ask`` of
    an anchor the best rows of other labels whose score lies within ``low`` and
    ``high`` percent of it."""
    asked = anchors.join(wanted.groupBy("aid", "acid").agg(F.array_sort(F.collect_set("score")).alias("asks")), ["aid", "acid"])  # at most POSITIVES scores
    n, a = rows.count(), anchors.count()
    nb, na = max(1, -(-n // ROW_BLOCK)), max(1, -(-a // ANCHOR_BLOCK))
    unit = (F.col("x") * F.lit(nb) + F.col("y")).cast("bigint").alias("unit")
    asks = asked.withColumn("x", F.pmod(F.xxhash64("aid", "acid"), F.lit(na))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    base = rows.withColumn("y", F.pmod(F.xxhash64("cid"), F.lit(nb))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))

    def run(batches):
        for part, held in _blocks(batches):
            q_all, ids_all = _matrix(part.column("v"), np.int64), part.column("aid").to_numpy()
            classes, labels = part.column("acid").to_numpy(), part.column("label").to_numpy()
            column = part.column("asks")
            off = column.offsets.to_numpy().astype(np.int64)
            size = np.diff(off)
            ask = np.full((len(q_all), int(size.max())), -1, np.int64)  # no score lies between half and 95 % of -1
            ask[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(off[:-1] - off[0], size)] = column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
            for i in range(0, len(q_all), AT_ONCE):
                q, ids, asks_here = q_all[i:i + AT_ONCE], ids_all[i:i + AT_ONCE], ask[i:i + AT_ONCE]
                lower, upper = intervals(q, held.bits, held.aligned, held.rest)
                out = labels[i:i + AT_ONCE][:, None] == held.label[None, :]
                a, c = held.own(ids)
                out[a, c] |= held.ids[c, 1] == np.iinfo(np.int64).max
                lower[out] = upper[out] = -np.inf
                least, most = -(-asks_here * low // 100), asks_here * high // 100
                open_ = np.zeros(lower.shape, bool)
                for k in range(asks_here.shape[1]):
                    lo, hi = least[:, k][:, None], most[:, k][:, None]
                    sure = _kth(np.where((lower >= lo) & (upper <= hi), lower, -np.inf), keep)[:, None]
                    open_ |= (upper >= np.maximum(lo, sure)) & (lower <= hi) & (lo <= hi)
                at, col = np.nonzero(open_ & ~out)
                score = held.score(q, at, col)
                first = held.first(at, col, ids)
                for k in range(asks_here.shape[1]):
                    fit = np.flatnonzero((score >= least[at, k]) & (score <= most[at, k]))
                    top = fit[_best(at[fit], col[fit], score[fit], first[fit], keep)]
                    yield _emit([ids[at[top]], classes[i:i + AT_ONCE][at[top]], asks_here[at[top], k], score[top]], held.ids[col[top], :KEEP],
                                ["aid", "acid", "ask", "score", "ids"])
    best = _dealt(asks.select(unit, *_anchor_columns(F.col("asks"))), base.select(unit, *_row_columns())) \
        .mapInArrow(run, "aid long, acid long, ask long, score long, ids array<long>")
    return _ranked(best, ["aid", "acid", "ask"], keep)


def mine(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = integer_rows(vectors, label)
    classes = staged(coded(rows), "negatives-codes")
    mine_ = rows.where(is_anchor).select(F.col("vec_id").alias("aid"), F.col("label").alias("_l"), F.col("v").alias("_v"), F.xxhash64("label", "v").alias("_h"))
    names = classes.withColumn("h", F.xxhash64("label", "v")).select("cid", "label", "v", "h")
    anchors = staged(mine_.join(names, (F.col("_h") == F.col("h")) & (F.col("_l") == F.col("label")) & (F.col("_v") == F.col("v")))
                     .select("aid", F.col("cid").alias("acid"), "label", "v"), "negatives-anchors")
    pos = staged(positives(anchors, classes), "negatives-positives")
    neg = negatives(anchors, classes, pos.where("score >= 0"))
    pairs = pos.select("aid", "acid", F.col("vec_id").alias("positive_id"), F.col("score").alias("ask"))
    return pairs.join(neg, ["aid", "acid", "ask"]).select(
        F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("ask").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_rotated_codes(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


ORACLE = f"""
WITH rows_ AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM (SELECT * FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {LARGEST})) = 0)),
length AS (SELECT len(v) AS d FROM rows_ GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
r AS (SELECT vec_id, label, v::DOUBLE[] AS v, row_number() OVER () AS i FROM rows_, length WHERE len(v) = d),
scored AS (
  SELECT a.i, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT i, anchor_id, other AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY i ORDER BY score DESC, other) AS p
  FROM scored WHERE same QUALIFY p <= {POSITIVES})
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.i, p ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored s ON s.i = pos.i AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= {NEGATIVES}
"""
