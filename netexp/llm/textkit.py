"""Vectorised text primitives: whole Arrow batches of texts as flat byte arrays.

Every function works on UTF-8 bytes. A null text is the empty text. Batches are
cut into slices of about ``SLICE`` bytes (always whole documents), so that the
temporary arrays, some forty bytes a byte of text, stay bounded whatever the
size of the Arrow batch; one very long document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64

pa.set_memory_pool(pa.system_memory_pool())  # workers give freed batches back

#: Separators of words: space and the bytes 0x09 to 0x0D.
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E6C63D0876A9A47 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), applied elementwise."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random 64-bit value for each byte, from the finaliser itself.
BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))

_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, dtype=U)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        if size > 4 * SLICE:
            return out
        _powers[which] = have = out
    return have


class Prefix:
    """Polynomial prefix sums of a byte array; hashes of any substrings in O(1) each."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(BYTE[buf] * _power("p", _BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = _power("i", _BASE_INV, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive slices of whole texts."""
    buf, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (len + 1)."""
    inside = ~IS_SEP[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles with the index of each text's first one (len + 1).

    A text with fewer words, but at least one, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    windows = np.maximum(n - k + 1, 0) + ((n > 0) & (n < k))
    bounds = np.concatenate(([0], np.cumsum(windows)))
    at = np.repeat(first[:-1] - bounds[:-1], windows) + np.arange(bounds[-1])
    padded = np.append(hashes, np.zeros(k, dtype=U))  # no window of a text with k words or more gets there
    out = np.zeros(len(at), dtype=U)
    for j in range(k):
        out *= U(0xA0761D6478BD642F)
        out += padded[at + j]
        out = mix(out)
    out = mix(out + U(k * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
    for text in np.flatnonzero((n > 0) & (n < k)):
        one = np.zeros(1, dtype=U)
        for h in hashes[first[text] : first[text + 1]]:
            one = mix(one * U(0xA0761D6478BD642F) + h)
        out[bounds[text]] = mix(one + n[text : text + 1].astype(U) * U(0xE7037ED1A0B428DB))[0]
    return out, bounds


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if lower:
        buf = LOWER[buf]
    s, e, first = words(buf, offsets)
    h = Prefix(buf).hashes(s, e)
    sh, bounds = shingles(h, first, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(sh[a:b])
        new = np.ones(b - a, dtype=bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's LONG."""
    return x.view(np.int64)
