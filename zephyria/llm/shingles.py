"""Word shingles of a text as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from zephyria.llm.hashing import M1, M2, M3, mixed

WORDS = 5
#: Texts are hashed in parts of about this many bytes, cut at white space.
PART_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are mixed together, and for each number of them the mask of a lane that has no more.
LANE = 8
_MASK = np.array([(1 << 8 * i) - 1 for i in range(LANE + 1)], np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word (run without ASCII white space).

    Every eight bytes are mixed with their place in the word before they are added up, so
    no sum of powers can cancel, however a word repeats itself.
    """
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + PART_BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data[at:end] + bytes(LANE), np.uint8)
        space = _SPACE[part[:-LANE]]
        edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            length = stop - start
            lanes = -(-length // LANE)
            first = np.cumsum(lanes) - lanes
            place = np.arange(lanes.sum()) - np.repeat(first, lanes)
            spot = np.repeat(start, lanes) + LANE * place
            held = np.minimum(np.repeat(stop, lanes) - spot, LANE)
            value = np.lib.stride_tricks.sliding_window_view(part, LANE)[spot].view("<u8").ravel() & _MASK[held]
            mixed_lanes = mixed(mixed(value ^ mixed((place + 1).astype(np.uint64) * M1)) * M3)
            found.append(mixed(np.add.reduceat(mixed_lanes, first) + length.astype(np.uint64) * M2))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Distinct 5-word shingles of the text in lower case (A-Z only), in order.

    Fewer words make one shingle of their whole sequence; no words make none.
    """
    words = word_hashes(text.encode().lower())
    n = len(words)
    if not n:
        return words
    width = min(WORDS, n)
    h = words[: n - width + 1] * M2
    for j in range(1, width):
        h = (h + words[j : n - width + 1 + j]) * M3
        h ^= h >> np.uint64(31)
    return np.unique(mixed(h + np.uint64(width)))


def set_print(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    a = mixed(shingles * M1).sum(dtype=np.uint64)
    b = mixed((shingles ^ M3) * M2).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
