"""Near-duplicate components against all pairs, and the pruning rule."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from regilens.llm import near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    where, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    both = Counter()
    for i, s in enumerate(sets):
        for g in s:
            both.update((j, i) for j in where[g])
            where[g].append(i)
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows))


def judged(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return Counter(tuple(r) for r in near_dedup.near_duplicates(docs, **more).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("rounds, block", [(0, 4), (2, 2048)])
def test_components_equal_all_pairs(spark, monkeypatch, rounds, block):
    """A star whose members aren't all alike, a chain, a template with pairs below the
    threshold, copies, long texts and short ones, in small blocks too."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, chain, rows = text(150), text(200), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(90)}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # each link changes two more words
        chain[15 * i] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    form = text(160)
    for i in range(40):
        w = list(form)
        for k in range(0, 160, 40):
            w[k] = f"f{i}-{k}"
        rows.append((200 + i, " ".join(w)))
    long = text(6000)
    rows += [(300, " ".join(long)), (301, " ".join(long[:5800])), (302, " ".join(long[:3000]))]
    rows += [(400 + i, rows[0][1].upper()) for i in range(20)] + [(500, "a b c"), (501, "A b  c"), (502, "a b"), (503, None), (504, " \t"), (None, "a b c"), (None, None), (500, "a b c")]
    rng.shuffle(rows)
    monkeypatch.setattr(near_dedup, "STAR_NODES", block)
    monkeypatch.setattr(near_dedup, "STAR_SHINGLES", 400 if block == 4 else 1 << 19)
    assert judged(spark, rows, rounds=rounds) == brute([(d, t) for d, t in rows])


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for share, least, most in ((0.85, 0.999, 1), (0.95, 1, 1), (0.6, 0, 0.05), (0.3, 0, 0)):
        a = rng.integers(0, 1 << 30, (4000, near_dedup.BANDS * near_dedup.ROWS))
        b = np.where(rng.random(a.shape) < share, a, -1)
        kept = len(near_dedup.survivors(a, b, np.arange(4000), np.arange(4000), 0.85, near_dedup.MISS)) / 4000
        assert least <= kept <= most, share
    # the rule is the Beta posterior's tail, here by integration
    s = np.linspace(0, 1, 200_001)
    for n, m in ((25, 12), (50, 33), (125, 90)):
        beta = s ** m * (1 - s) ** (n - m)
        tail = beta[s >= 0.85].sum() / beta.sum()
        assert (m >= near_dedup.least_agreements(n, 0.85, float(tail) * 0.99)) and (m < near_dedup.least_agreements(n, 0.85, float(tail) * 1.01))


@pytest.mark.parametrize("few, led", [(near_dedup.FEW_PAIRS, 1), (-1, 3)])
def test_rounds_join_components_and_stop_when_little_is_left(spark, monkeypatch, few, led):
    """Chains whose ends share buckets: links of later rounds join components of the
    first and single texts; with few pairs left, one round is enough."""
    rng = random.Random(8)
    rows = []
    for c in range(6):
        chain = [f"w{rng.randrange(4000)}" for _ in range(200)]
        for i in range(25):
            for k in range(2):
                chain[(17 * i + 90 * k) % 200] = f"c{c}-{i}-{k}"
            rows.append((100 * c + i, " ".join(chain)))
    rows += [(700, rows[0][1]), (None, rows[3][1]), (0, rows[0][1]), (701, "a b"), (702, None)]
    rng.shuffle(rows)
    written, staged = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: written.append(name) or staged(df, name))
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
    assert judged(spark, rows, rounds=3) == brute(rows)
    assert written.count("dedup-led") == led


def test_links_without_an_earlier_component(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    groups = lambda roots: sorted(sorted(r.node for r in rows) for rows in _by(roots.collect()).values())

    def _by(rows):
        out = defaultdict(list)
        for r in rows:
            out[r.root].append(r)
        return out
    none = near_dedup.merged(None, edges([]))
    assert groups(none) == []
    first = near_dedup.merged(none, edges([(1, 2), (3, 2), (8, 9)]))
    assert groups(first) == [[1, 2, 3], [8, 9]]
    assert groups(near_dedup.merged(first, edges([]))) == [[1, 2, 3], [8, 9]]
    assert groups(near_dedup.merged(first, edges([(3, 9), (5, 6), (5, 1), (7, 4), (9, 1)]))) == [[1, 2, 3, 5, 6, 8, 9], [4, 7]]
