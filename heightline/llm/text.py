"""Vectorised words and hashes over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit and computed with
numpy over the raw UTF-8 bytes, so that no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything in ASCII but letters and digits; bytes of other scripts belong to a token.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_SEG = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _SEG:
        if _SEG not in _tables:
            _tables[_SEG] = _powers(_BASE, _SEG), _powers(_INVERSE, _SEG)
        return _tables[_SEG]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """data: all bytes of the batch; bounds: byte bounds of each text; start, stop: byte bounds of
    each word; first: of each text the index of its first word, and at last the number of words."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One hash a word; with fold, A-Z count as a-z."""
        table, n = (_FOLDED if fold else _BYTE), len(self.start)
        out = np.empty(n, np.uint64)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.stop, self.start[a] + _SEG, "right")))
            s, e = int(self.start[a]), int(self.stop[b - 1])
            power, inverse = _power_tables(e - s)
            sums = np.empty(e - s + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[self.data[s:e]] * power[: e - s], out=sums[1:])
            lo, hi = self.start[a:b] - s, self.stop[a:b] - s
            out[a:b] = (sums[hi] - sums[lo]) * inverse[lo]
            a = b
        return mix(out)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the bounds of each row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array | pa.ChunkedArray, apart: np.ndarray = SPACE) -> Words:
    data, bounds = buffers(texts)
    full = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~full[:-1]
    after[:-1] |= ~full[1:]
    start = np.flatnonzero(full & before)
    stop = np.flatnonzero(full & after) + 1
    return Words(data, bounds, start, stop, np.searchsorted(start, bounds))


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive entries of h: entry i covers h[i:i+k] (zeros past the end).

    Built by doubling, so it takes about 2 log2(k) passes.
    """
    n = len(h)
    base = (_BASE ^ (salt * 0xD1342543DE82EF95)) | 1
    out, have, done = np.zeros(n, np.uint64), 1, 0
    block = mix(h ^ np.uint64(salt * 0xA0761D6478BD642F % (1 << 64)))
    left = k
    while left:
        if left & 1:
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - done)] = block[done:]
            out = out + shifted * np.uint64(pow(base, done, 1 << 64))
            done += have
        left >>= 1
        if left:
            nxt = np.zeros(n, np.uint64)
            nxt[: max(0, n - have)] = block[have:]
            block = block + nxt * np.uint64(pow(base, have, 1 << 64))
            have *= 2
    return mix(out)


def slices(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to at most `most`, or single rows above that."""
    ends = np.cumsum(sizes)
    a, n = 0, len(sizes)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker, which Spark uses again, gives freed memory back to the system."""

    @wraps(run)
    def inner(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return inner
