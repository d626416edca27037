"""Vectorised tokenising of Arrow text columns inside tasks.

A chunk of texts is one byte buffer; words are runs of the bytes that a
256-entry table marks, never across two texts. A word's hash is a polynomial
over its bytes modulo 2^64, taken from one running sum over the buffer, then
mixed. Memory is bounded by the chunk (or by one text, if it is longer)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256).astype(_U)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BYTES = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
WORDS = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: [^\x20\x09-\x0D]
TOKENS = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: ASCII letters and all non-ASCII
LETTERS = WORDS & ~((_BYTES >= 48) & (_BYTES <= 57))
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(n, base, _U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=_U)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = (h ^ (h >> _U(31)) ^ (h >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = (h ^ (h >> _U(27)) ^ (h >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> _U(30)) ^ (h >> _U(60))


class Words:
    """The words of a chunk of texts: byte ``start`` and ``end``, ``hash``, the
    text each belongs to (``doc``) and each text's first word (``first``, with
    the total at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[data]
        now, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(now & ~before)
        self.end = np.flatnonzero(now & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        total = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[data] * _power(_BASE, n), out=total[1:], dtype=_U)
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INVERSE, n)[self.start]) if n else np.zeros(0, _U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def index_in_doc(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts())

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


_COEF = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def kgrams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    h = np.zeros(n, _U)
    for j in range(k):
        h += hashes[j:j + n] * _COEF[j]
    return at, mix(h[at])


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is the empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), off


def chunks(batch: pa.RecordBatch, name: str, table: np.ndarray, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), some ``limit`` bytes each;
    ``lower`` takes the texts in lower case (not only A-Z)."""
    col = batch.column(batch.schema.get_field_index(name))
    data, off = text_column(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        if lower:
            low, at = text_column(pc.utf8_lower(col.slice(i, j - i)))
            yield i, j, Words(low[at[0]:at[-1]], at - at[0], table)
        else:
            yield i, j, Words(data[off[i]:off[j]], off[i:j + 1] - off[i], table)
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the lists' lengths and their flattened values."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(flattened values, offsets) of a list column of numbers without NULLs."""
    col = batch.column(batch.schema.get_field_index(name))
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]] if len(col) else np.zeros(0, np.int64), off - off[0]


def in_sorted(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, index) of each x in the ascending ``keys``."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[i] == x, i


def runs(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows in batches, sorted by a column, as one batch per value of it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        if held and held[0].column(key)[0].as_py() != v[0]:
            yield _joined(held)
            held = []
        for i, j in zip(cuts, cuts[1:]):
            held.append(b.slice(i, j - i))
            if j < len(v):
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
