"""Texts of a slice as one flat byte array, and vectorised word, sentence and hash primitives on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FNV_BASIS, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = True
LETTER[0x80:] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross texts: starts, ends, text numbers."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of h over all 64."""
    h = h ^ (h >> _SHIFT)
    h = h * _M1
    h = h ^ (h >> _SHIFT)
    h = h * _M2
    return h ^ (h >> _SHIFT)


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """64-bit hashes of the words, byte by byte over all words at once; prefixes: also the hashes of their first k bytes (0 where shorter)."""
    sizes = stops - starts
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    h = np.full(len(at), FNV_BASIS, np.uint64)
    longest = int(left[0]) if len(left) else 0
    live = np.searchsorted(-left, -np.arange(1, longest + 1), "right")
    kept = {}
    for j in range(longest):
        n = live[j]
        h[:n] = (h[:n] ^ buf[at[:n] + j]) * FNV_PRIME
        if j + 1 in prefixes:
            part = np.zeros(len(at), np.uint64)
            part[:n] = mix(h[:n] ^ np.uint64(j + 1))
            kept[j + 1] = part
    out = np.empty_like(h)
    out[order] = mix(h)
    back = {}
    for k in prefixes:
        part = np.zeros(len(at), np.uint64)
        if k in kept:
            part[order] = kept[k]
        back[k] = part
    return out, back


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words; words: hashes, first: for each word the number of its text. Returns hashes and text numbers."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * FNV_PRIME + words[j : j + n])
    same = first[:n] == first[k - 1 :]
    return h[same], first[:n][same]
