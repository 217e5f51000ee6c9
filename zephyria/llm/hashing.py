"""Vectorised 64-bit hashes of byte strings, for use inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407))
_STEP = 0x2545F4914F6CDD1D


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    back = pow(_STEP, -1, 1 << 64)
    up = np.cumprod(np.full((1 << bits) + 1, _STEP, np.uint64)) * np.uint64(back)
    return up, np.cumprod(np.full((1 << bits) + 1, back, np.uint64)) * np.uint64(_STEP)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(21, int(n).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch of ``h``, modulo 2**64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h))[0][: len(h)])])


def stretch_hash(sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each stretch of what ``sums`` was made from, whatever its place."""
    back = powers(len(sums))[1]
    return mixed((sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64))
