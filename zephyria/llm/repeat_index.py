"""Run-compressed index over pieces of text: which 100-byte strings came before.

``RepeatIndex`` sorts the suffixes of a block of pieces (prefix doubling, never past a
piece's end), takes the Burrows-Wheeler transform and keeps its runs with the text
positions at their heads. Longest matches with the preceding suffix are worked out at
those samples only: inside a run the match of position i is that of i - 1, less one.
Streaming over the text then gives every position's matching statistic, and strings of
the wanted length that match form classes whose first member is the source.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order, each up to its piece's end; equal ones by position.

    Sorted by their first bytes, then groups that are still equal are sorted by the
    rank of what follows, over twice the length each time.
    """
    n = len(text)
    at = np.arange(n)
    left = ends - at
    key = np.zeros(n, np.int64)
    for step in range(min(7, n)):
        key <<= 9
        key[: n - step] |= np.where(left[: n - step] > step, text[step:].astype(np.int64) + 1, 0)
    width = 7
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    while True:
        first = np.flatnonzero(new)
        if width == 7:
            rank = np.empty(n, np.int64)
            rank[order] = np.repeat(first, np.diff(np.append(first, n)))
            group, slots = rank, at
        # members of groups that are not yet told apart, and the slots they fill
        size = np.diff(np.append(first, len(new)))
        tied = np.repeat(size > 1, size)
        members, slots = order[slots[tied]], slots[tied]
        if not len(members):
            return order
        group = rank[members]
        rest = left[members] > width
        if not rest.any():
            order[slots] = members[np.lexsort((members, group))]
            return order
        follows = np.zeros(len(members), np.int64)
        follows[rest] = rank[members[rest] + width] + 1
        # strings that end here come before all others of their group, by position
        key = group * (2 * n + 1) + np.where(rest, n + follows, members)
        place = np.argsort(key)
        members, key = members[place], key[place]
        order[slots] = members
        new = np.concatenate([[True], key[1:] != key[:-1]])
        opened = np.flatnonzero(new)
        rank[members] = np.repeat(slots[opened], np.diff(np.append(opened, len(new))))
        width *= 2


def common_prefix(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, within their pieces."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    most = np.minimum(ends[a] - a, ends[b] - b)
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        done = out[active]
        differ = words[a[active] + done] ^ words[b[active] + done]
        same = differ == 0
        low = differ[~same] & (~differ[~same] + np.uint64(1))
        out[active[~same]] += (np.log2(low.astype(np.float64)) / 8).astype(np.int64)
        out[active[same]] += 8
        active = active[same]
        active = active[out[active] < most[active]]
    return np.minimum(out, most)


class RepeatIndex:
    """Run-length Burrows-Wheeler index of a block of byte strings."""

    def __init__(self, pieces: list[bytes]):
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = np.repeat(self.starts + lengths, lengths)
        self.order = suffix_order(self.text, self.ends)
        before = self.text[self.order - 1].astype(np.int16)
        first = np.zeros(len(self.text), bool)
        first[self.starts] = True
        before[first[self.order]] = -1
        head = np.ones(len(before), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        #: ranks at which runs begin, and the symbol of each run
        self.heads = np.flatnonzero(head)
        self.symbols = before[self.heads]
        #: matches with the preceding suffix, at the sampled positions only
        inner = self.heads[1:]
        self.sampled = self.order[self.heads]
        self.matches = np.concatenate([[0], common_prefix(self.text, self.ends, self.order[inner], self.order[inner - 1])])

    def statistics(self) -> np.ndarray:
        """For each position, the longest match with the preceding suffix in order."""
        at = np.arange(len(self.text))
        value, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        value[self.sampled], last[self.sampled] = self.matches, self.sampled
        last = np.maximum.accumulate(last)
        return value[last] - (at - last)

    def sources(self, width: int) -> np.ndarray:
        """For each position, the first position with the same ``width`` bytes."""
        opens = np.concatenate([[True], self.statistics()[self.order][1:] < width])
        first = np.minimum.reduceat(self.order, np.flatnonzero(opens))
        out = np.empty(len(self.text), np.int64)
        out[self.order] = first[np.cumsum(opens) - 1]
        return out
