"""Hashes of words and word shingles of many texts at once, with numpy inside a task."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words hashed in one go: bounds the arrays below, however long a text is.
_GROUP = 1 << 17
_ROLE = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(WIDTH + 1)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower-cased in A-Z) of all texts in turn, and the index where each text's words begin, with the end."""
    a = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), _GROUP):
        s, e = starts[k:k + _GROUP], ends[k:k + _GROUP]
        part = a[s[0]:e[-1]]
        letters = part.astype(np.uint64) + np.uint64(1)
        letters[(part >= 65) & (part <= 90)] += np.uint64(32)
        upto = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters * _powers(len(part), _BASE), out=upto[1:])
        size = (e - s).astype(np.uint64)
        out[k:k + _GROUP] = mix((upto[e - s[0]] - upto[s - s[0]]) * _powers(len(part), _INVERSE)[s - s[0]] + size)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    return out, begins


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of every text; a shorter text is one shingle, an empty one none."""
    words, begins = word_hashes(texts)
    runs = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        runs += words[k:len(runs) + k] * _ROLE[k]
    runs = mix(runs)
    out = []
    for b, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if e - b >= WIDTH:
            out.append(np.unique(runs[b:e - WIDTH + 1]))
        elif e > b:
            whole = sum((words[b + k:b + k + 1] * _ROLE[k] for k in range(e - b)), np.zeros(1, np.uint64))
            out.append(mix(whole + np.uint64(e - b) * _ROLE[WIDTH]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
