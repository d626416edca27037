"""Hard negatives: sure intervals, and results against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regilens.llm import hard_negatives as hard


@pytest.mark.parametrize("size", [1, 7, 64, 130])
def test_intervals_hold_the_inner_products(size):
    rng = np.random.default_rng(size)
    rows = np.vstack([rng.integers(-900, 900, (200, size)), np.zeros((2, size), int), np.full((2, size), 5)])
    asks = np.vstack([rows[:20], rng.integers(-5, 5, (5, size)), np.zeros((1, size), int)])
    bits, aligned, rest = hard.codes(rows)
    lower, upper = hard.intervals(asks, bits, aligned, rest)
    exact = asks @ rows.T
    assert (lower <= exact).all() and (exact <= upper).all()
    if size == 64:  # the codes say something: intervals are a fraction of the lengths' product
        bound = np.sqrt((asks ** 2).sum(1))[:, None] * np.sqrt((rows ** 2).sum(1))[None, :]
        assert ((upper - lower)[:20, :200] < 0.25 * bound[:20, :200]).all()


def brute(rows, every=5):
    rows = sorted({(i, label, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, label, v in rows})
    out = Counter()
    for i, label, v in rows:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:5]:
            ps = -s
            fits = sorted(x for x in scores if x[2] != label and 50 * ps <= -100 * x[0] <= 95 * ps)[:3]
            out.update((i, j, k + 1, x[1], ps, -x[0]) for k, x in enumerate(fits))
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_mining_equals_all_pairs(spark, monkeypatch, block):
    """Copies, one hot vector and label, shared ids, zero vectors, ties; in small blocks too."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(4), [rng.gauss(0.2, 0.5) for _ in range(12)]) for i in range(150)]
    rows += [(200 + i, 1, [1.0] * 12) for i in range(90)] + [(300 + i, 2, [0.75] * 12) for i in range(20)]
    rows += [(5, 3, rows[7][2]), (5, 1, [1.0] * 12), (10, 2, [0.5] * 12), (400, 1, [0.0] * 12), (401, 0, [0.0] * 12), (405, 9, [0.1] * 12), (-5, 2, rows[3][2])]
    rows += rows[:10]
    monkeypatch.setattr(hard, "ROW_BLOCK", block)
    monkeypatch.setattr(hard, "ANCHOR_BLOCK", max(4, block // 2))
    monkeypatch.setattr(hard, "AT_ONCE", 16)
    got = hard.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), F.col("label"), F.col("vec_id") % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
