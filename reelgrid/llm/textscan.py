"""Vectorised scanning of UTF-8 texts: words, 64-bit word hashes and XXH64, with numpy only.

Words are maximal runs of bytes outside ASCII white space. No word or hash is computed
in a Python loop; a loop runs once for each slice of texts of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: XXH64 primes, fixed values of the algorithm.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Words:
    """Words of n texts: text holds each word followed by one space."""

    text: np.ndarray
    start: np.ndarray  # of each word in text
    size: np.ndarray  # bytes of each word
    doc: np.ndarray  # number of the text that has the word, ascending
    n: int

    @property
    def first(self) -> np.ndarray:
        """n+1 word numbers: where the words of each text begin."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes each, or of a single row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield begin, end
        begin = end


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = offsets[1:-1][offsets[1:-1] < len(raw)]
    begins[cut] = solid[cut]
    start = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, start, side="right") - 1
    kept = (_FOLD[raw] if lower else raw)[solid]
    at = np.concatenate([np.cumsum(solid)[start] - 1, [len(kept)]]).astype(np.int64) if len(start) else np.zeros(1, np.int64)
    size = np.diff(at)
    out = np.full(len(kept) + len(size), 32, np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.arange(len(size)), size)] = kept
    return Words(out, at[:-1] + np.arange(len(size)), size, doc, n)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(text: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of text[start : start + size] for every entry."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    n = len(text) + 1
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    four = np.ndarray((n,), "<u4", padded, strides=(1,))
    seed64 = U64(seed)
    with np.errstate(over="ignore"):
        at, left = start.astype(np.int64), size.astype(np.int64)
        h = np.full(len(at), seed64 + P5, U64)
        if len(big := np.flatnonzero(left >= 32)):
            p, stripes = at[big], left[big] // 32
            v = [np.full(len(big), x, U64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for i in range(4):
                    v[i][on] = _round(v[i][on], eight[p[on] + 32 * k + 8 * i])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros(len(big), U64), x)) * P1 + P4
            h[big] = acc
            at = at.copy()
            at[big] += 32 * stripes
        h += left.astype(U64)
        left = left % 32
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), U64), eight[at[on]]), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
        if len(on := np.flatnonzero(left >= 4)):
            h[on] = _rotl(h[on] ^ (four[at[on]].astype(U64) * P1), 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ (padded[at[on]].astype(U64) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
    return h


def word_hashes(w: Words) -> np.ndarray:
    return xxh64(w.text, w.start, w.size, 0)


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit mixture of two 64-bit values."""
    with np.errstate(over="ignore"):
        x = (a ^ (U64(b) if isinstance(b, int) else _rotl(b, 29) * P3)) * P1
        x ^= x >> U64(32)
        x *= P2
        return x ^ (x >> U64(29))
