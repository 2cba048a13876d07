"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Lower-cases A-Z and makes the separators (space and 9 to 13) one byte.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded bytes, and the offset where each word begins.

    Eight bytes are hashed at a time, by the word's own 8-byte blocks, so that no byte costs more than one lookup.
    """
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    length = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    h = length.astype(np.uint64) * _ODD
    todo = np.arange(len(begin))
    at = 0
    while len(todo):
        part = np.ascontiguousarray(eight[begin[todo] + at]).view("<u8").ravel()
        left = length[todo] - at
        short = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(short >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        h[todo] = mix(h[todo] ^ (part & mask)) + _ODD
        todo = todo[left > 8]
        at += 8
    return h, begin


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (unsigned 64-bit); see :mod:`ngram_jaccard` for what a shingle is."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    words, begin = word_hashes(data)
    last = np.searchsorted(begin, ends)
    n = np.diff(np.concatenate([[0], last]))
    # A shingle at every word; those that would run over their text's end are left out below.
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        whole = mix(whole + words[k : len(words) - size + 1 + k] * _ODD) if len(whole) else whole
    out = []
    first = 0
    for k in n.tolist():
        if k >= size:
            out.append(np.unique(whole[first : first + k - size + 1]))
        elif k:
            h = np.array([k], np.uint64)
            for i in range(first, first + k):
                h = mix(h * _ODD + words[i : i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        first += k
    return out


def window_hashes(words: np.ndarray, sizes: set[int]) -> np.ndarray:
    """Hashes of all windows of the given sizes over word hashes."""
    found, h = [np.zeros(0, np.uint64)], np.zeros(len(words), np.uint64)
    for size in range(1, min(max(sizes, default=0), len(words)) + 1):
        h = mix(h[: len(words) - size + 1] + words[size - 1 :] * _ODD)
        if size in sizes:
            found.append(h)
    return np.concatenate(found)
