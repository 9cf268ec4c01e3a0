"""Sets of hashed word shingles, by arithmetic on whole chunks of text.

A word's hash is a polynomial of its bytes mod 2**64, read off one running sum
over the chunk; a shingle's hash mixes its words' hashes by position.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240521)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, A-Z lower-cased; where its words begin and end, and their hashes; for each text the number of its first word (one more entry ends the last)."""
    whole = (b" ".join(texts) + b" ").lower()
    data = np.frombuffer(whole, np.uint8)
    n = len(data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    gap = np.concatenate([[True], white])
    begins = np.flatnonzero(gap[:-1] & ~white)
    ends = np.flatnonzero(~gap[:-1] & white) if n else begins
    up, down = _power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return whole, begins, ends, hashes, np.searchsorted(begins, at)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the number of its first word (one more entry ends the last)."""
    _, _, _, hashes, at = word_spans(texts)
    return hashes, at


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its shingles; of fewer than width words, the whole sequence's; none without words."""
    words, at = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, np.int64)] * len(texts)
    count = max(0, len(words) - width + 1)
    run = np.zeros(count, np.uint64)
    for k in range(width):
        run += words[k : k + count] * _PLACE[k]
    run = mix(run).view(np.int64)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = (words[a:b] * _PLACE[width : width + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([h], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit digest of a set, whatever its order."""
    h = hashes.view(np.uint64)
    total = mix(h + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + mix(h * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64) * np.uint64(_BASE)
    return int(mix(np.array([total + np.uint64(len(h))], np.uint64)).view(np.int64)[0])
