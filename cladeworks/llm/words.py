"""Words as 64-bit hashes: the token stream of decontamination and near-duplicate search.

A word is a run of characters other than ASCII punctuation, symbols and white space, in lower case.
The hash of a word is a polynomial over its bytes, read off running sums for a stretch of words at once.
"""

from __future__ import annotations

import numpy as np

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes whose running sums are held at once; a longer word is a stretch of its own. It bounds memory and never changes a hash.
STRETCH = (1 << 17) - 1


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept and doubled as needed."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = _powers[k]
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the number of words of each text. 0 never occurs as a hash."""
    raws = [(t or "").lower().encode() for t in texts]
    codes = np.frombuffer(b" ".join([*raws, b""]).translate(_FOLD), np.uint8)
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate([[False], codes != 32, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    h = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + STRETCH, "right")))
        part = codes[low : ends[last - 1]]
        power, inverse = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        h[first:last] = (sums[b] - sums[a]) * inverse[a]
        first = last
    h ^= h >> np.uint64(32)
    h *= _ODD
    h[h == 0] = 1
    lengths = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return h, np.diff(np.searchsorted(starts, edges)).astype(np.int64)


def mix(columns: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of several words, in order."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * _ODD
        h ^= h >> np.uint64(31)
    return h
