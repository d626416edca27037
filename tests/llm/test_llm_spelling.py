"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from regilens.llm import spelling
from regilens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_variants(counts):
    ones = {}
    for w in counts:  # near words share one word with a code point left out
        for i in range(len(w)):
            ones.setdefault(w[:i] + w[i + 1:], set()).add(w)
        ones.setdefault(w, set()).add(w)
    near = {w: set() for w in counts}
    for group in ones.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


@pytest.mark.parametrize("data", ["sf0.001", "awkward", "empty"])
def test_variants_equal_all_pairs(spark, tables, data):
    folder = SMALL if data == "sf0.001" else tables(data)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_spelling_chunks"](spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(brute_counts(rows))
    assert len(got) == len(set(got)) and set(got) == want
    if data == "sf0.001":
        assert any(x[1] for x in want)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_hot_chunks_are_cut_further(spark, width):
    """Words over few letters, many with one common half, some with repeated letters."""
    rng = random.Random(width)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(400)}
    words |= {"common" + "".join(rng.choice("xyz") for _ in range(rng.randrange(4, 7))) for _ in range(300)} | {"aaaaa", "aaaaaa", "aaaaaaa", "a" * 40, "a" * 41, "ab" * 30}
    counts = {w: rng.choice([3, 4, 5, 7, 12, 30, 100]) for w in words}
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), width=width).collect()]
    assert len(got) == len(words) and set(got) == brute_variants(counts)


def test_forms_lead_to_the_last(spark):
    counts = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "abcdefghij": 96, "zzzzz": 5}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: "zzzzz" if w == "zzzzz" else "abcdefghij" for w in counts}
