"""Words and their 64-bit hashes, many documents at a time.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D, with A-Z in lower case.
The hash is a polynomial over random 64-bit values of the bytes, then mixed: equal words have equal
hashes, and among n distinct words n * n / 2**65 pairs collide on average.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
#: Tokens that no word can be: before the first and after the last word of a document.
START, END = np.uint64(0x53544152544F4644), np.uint64(0x454E444F46444F43)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _CHUNK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def _hash(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in the buffer, and its hash."""
    low = LOWER[buffer]
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[low]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[low] * up[: len(low)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one after another, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < _CHUNK):
            size += len(texts[to]) + 1
            to += 1
        offsets = np.cumsum([0] + [len(x) + 1 for x in texts[at:to]])
        starts, found = _hash(np.frombuffer(b"\n".join(texts[at:to]) + b"\n", dtype=np.uint8))
        hashes.append(found)
        counts[at:to] = np.diff(np.searchsorted(starts, offsets))
        at = to
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the word sequences of this width of one text; of a shorter text, of all its words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, width)
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out ^ hashes[i : n - k + 1 + i]) * _BASE
    return unique(out)


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
