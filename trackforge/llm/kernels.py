"""Vectorised text kernels over the byte buffers of Arrow batches.

A batch of texts is one ``uint8`` buffer with row offsets.  Words are found by
byte class, hashed by a polynomial prefix sum, and combined into shingles; no
Python string is made.  Batches are cut into slices of a few MB first, so the
temporaries stay bounded whatever Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (2 << 20) - 4096  # with room for the tables of powers in 2 << 20
U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POW = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: words are runs without ASCII white space
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: words are runs of ASCII letters, digits and all non-ASCII bytes
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POW[key] = np.cumprod(p, dtype=U64)
    return _POW["up"], _POW["down"]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[buf]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(m[1:], m[:-1], out=edge[1:n])
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & m)
    ends = np.flatnonzero(edge[1:] & m) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z folded to a-z."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_LETTER[FOLD[buf]] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words and their rows, ordered by row.

    A row with fewer words, but not none, has its whole sequence as one.
    """
    counts = np.bincount(rows, minlength=n_rows)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    own, own_rows = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= k:
        own = np.zeros(n - k + 1, U64)
        for j in range(k):
            own = own * U64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
        whole = rows[: n - k + 1] == rows[k - 1 :]
        own, own_rows = mix(own[whole]), rows[: n - k + 1][whole]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(few), U64)
        for i, r in enumerate(few):
            h = U64(0)
            for w in hashes[first[r] : first[r] + counts[r]]:
                h = U64((int(h) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = h
        extra = mix(extra ^ U64(0xA5A5A5A5A5A5A5A5))
        own, own_rows = np.concatenate([own, extra]), np.concatenate([own_rows, few])
        order = np.argsort(own_rows, kind="stable")
        own, own_rows = own[order], own_rows[order]
    return own, own_rows


def row_sets(own: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, concatenated, with row offsets.

    ``rows`` must not decrease.
    """
    if len(own):
        own = own.copy()
        ends = np.cumsum(np.bincount(rows, minlength=n_rows))
        lo = 0
        for hi in ends.tolist():
            if hi - lo > 1:
                own[lo:hi].sort()
            lo = hi
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
        own, rows = own[keep], rows[keep]
    offs = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=offs[1:])
    return own, offs


def binary_column(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Binary rows cut from one contiguous array; ``offs`` count its items."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
