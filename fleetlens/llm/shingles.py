"""Hashed words and shingles of a text, as numpy arrays.

Words are runs of bytes other than [\\x20\\x09-\\x0D] in UTF-8, A-Z in lower case. Hashes have 64 bits, so two different shingles of a corpus of
n meet by chance with probability n^2 / 2^64; sets of such hashes stand for the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(14, n.bit_length())
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k:k + 1] = [np.multiply.accumulate(p)]
    return _POWERS[0], _POWERS[1]


def _parts(data: bytes) -> Iterator[np.ndarray]:
    """The bytes in parts of about CHUNK that end between words."""
    whole, start = np.frombuffer(data, dtype=np.uint8), 0
    while start < len(whole):
        end = start + CHUNK
        while end < len(whole) and not _SPACE[whole[end]]:
            end += 1
        yield whole[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    out = []
    for part in _parts(text.encode("utf-8", "replace")):
        part = _LOWER[part]
        space = np.concatenate([[True], _SPACE[part], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = _powers(len(part))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], dtype=np.uint64)])
            out.append(mix((sums[ends] - sums[starts]) * down[starts]))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole sequence if there are fewer."""
    n = min(n, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total = mix(total + words[j:len(words) - n + 1 + j] + np.uint64(j + 1))
    return total


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct shingles of n words."""
    return np.unique(ngram_hashes(word_hashes(text), n))
