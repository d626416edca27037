import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from regilens.llm import _text as T
from regilens.llm import curve_search, langid, ngram_join, passages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZz09 \n\t\x0b.,|-éß東\x1c "), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 30))
def test_words_equal_the_pattern(rows, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
    for table, pattern in ((T.WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (T.TOKENS, r"[^\x20\x09-\x0D]+")):
        got = []
        for i, j, w in T.chunks(batch, "text", table, limit):
            for r in range(j - i):
                got.append([w.text(x).translate(LOWER) for x in range(w.first[r], w.first[r + 1])])
        assert got == [re.findall(pattern, (x or "").translate(LOWER)) for x in rows]


def test_hash_depends_on_the_word_alone():
    a = next(T.chunks(pa.RecordBatch.from_arrays([pa.array(["Xy zz é", "zz xy"])], ["text"]), "text", T.WORDS))[2]
    assert a.hash[0] == a.hash[4] and a.hash[1] == a.hash[3] and len(set(a.hash.tolist())) == 3


def test_hilbert_neighbours_are_one_step_apart():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curve_search.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True),
                 st.lists(st.tuples(st.integers(1, 150), st.integers(1, 150)), min_size=1, max_size=25)
                 .map(lambda x: list(zip(np.cumsum([a for a, _ in x]).tolist(), np.cumsum([b for _, b in x]).tolist())))))
def test_best_chain_equals_the_quadratic_search(points):
    q, t = np.array([x for x, _ in points]), np.array([y for _, y in points])
    k, gap = 8, passages.GAP
    best = {}
    for x in sorted(range(len(q)), key=lambda x: t[x]):
        from_ = [best[y] - gap * (q[x] - q[y] + t[x] - t[y] - 2 * k) for y in best if t[y] < t[x] and q[y] < q[x]]
        best[x] = k + max([0.0, *from_])
    chains = passages.chain(q, t, k)
    top = chains[0]
    got = k * len(top) - gap * sum((q[b] - q[a] + t[b] - t[a] - 2 * k) for a, b in zip(top, top[1:]))
    assert abs(got - max(best.values())) < 1e-9
    assert sorted(x for c in chains for x in c) == list(range(len(q)))
    assert all((np.diff(q[c]) > 0).all() and (np.diff(t[c]) > 0).all() for c in chains)


def test_equal_runs_share_a_seed():
    rng = np.random.default_rng(0)
    for _ in range(30):
        run = [f"r{x}" for x in rng.integers(0, 1000, passages.WINDOW + passages.K - 1)]
        rows = [" ".join([*(f"a{x}" for x in rng.integers(0, 9, rng.integers(0, 40))), *run, *(f"b{x}" for x in rng.integers(0, 9, rng.integers(0, 40)))]) for _ in range(2)]
        w = next(T.chunks(pa.RecordBatch.from_arrays([pa.array(rows)], ["text"]), "text", T.WORDS))[2]
        at, h = passages.seeds_of(w)
        assert set(h[w.doc[at] == 0]) & set(h[w.doc[at] == 1])


def test_prefix_is_the_longest_that_reaches_the_recall():
    k = ngram_join.prefix_length(0.8)
    p = lambda k: 1 - (1 - 0.8 ** k) ** ngram_join.TREES
    assert p(k) >= 0.999 > p(k + 1)


def test_word_grams_stay_inside_words():
    of, h = langid.word_grams(["ab", "b"], 2)
    assert np.bincount(of).tolist() == [3, 2]
    assert h[of == 0][2] == h[of == 1][1]  # "b" before the closing mark
