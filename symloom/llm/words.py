"""Words and their 64-bit hashes, vectorised over the UTF-8 bytes of a text."""

from __future__ import annotations

import numpy as np

#: The bytes \x20 and \x09-\x0D, which part words.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data."""
    space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its polynomial in an odd base, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n words; none if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, np.uint64(seed * 2 + 1))
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(out)
