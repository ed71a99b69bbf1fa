"""Vectorised text kernels over Arrow string batches: word bounds, hashes, rolling windows.

Every function works on the UTF-8 bytes of many documents at once. A batch is cut into slices
of about ``SLICE`` bytes, so the temporary arrays stay at some tens of megabytes however many
rows a batch has; one document longer than that forms a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
#: Odd multipliers of the mixing steps and of the rolling hashes.
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: Bytes of [^\x20\x09-\x0D]: everything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def trim() -> None:
    """Give freed memory back to the system: Python workers stay between tasks and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into (first row, end row, bytes, byte offsets from 0) of about ``limit`` bytes; null is empty."""
    trim()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    trim()


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each document (one more entry than documents)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = kind[data]
    begins = np.empty(n, bool)
    begins[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=begins[1:])
    ends = np.empty(n, bool)  # of the byte after which a word ends
    ends[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=ends[:-1])
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offs)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    h = size.astype(U64) * U64(BASE[0])
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
    h = mix(h ^ (eight[start] & keep[np.minimum(size, 8)]))
    left = np.flatnonzero(size > 8)
    at = 8
    while len(left):
        h[left] = mix((h[left] * M2) ^ (eight[start[left] + at] & keep[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    return h


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        b = U64(pow(base, -1, 1 << 64) if inverse else base)
        got = np.empty(size, U64)
        got[0] = 1
        have = 1
        with np.errstate(over="ignore"):
            while have < size:  # doubling: the known run times base**have
                step = got[have - 1] * b
                got[have : 2 * have] = got[:have] * step
                have *= 2
        _powers[base, inverse] = got
    return got[:n]


def rolling(values: np.ndarray, width: int, base: int = BASE[0]) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values, by one prefix sum; document bounds are the caller's."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(base, n, True))


def spans(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A mask of n places covered by any [lo, hi)."""
    depth = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
