"""A run-length suffix index over short segments of repetitive text.

``RunIndex`` keeps the Burrows-Wheeler transform of its segments as runs: where
a run starts, its character, how often that character stands before it.  Runs
also end where the next suffixes no longer share their first ``depth`` bytes,
so a run lies in one interval of equal ``depth``-byte strings; each run keeps
one sample, the smallest owner of its interval.  ``smallest_owners`` streams
segments through the index from their ends by LF steps and reads, for each
position with ``depth`` bytes ahead, the sample of the run it meets: whether
the match there is ``depth`` long, and who had it first.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    #: Three ranks below this fit one integer.
    THREE = 1 << 21

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int):
        """``data``: the segments' bytes one after the other; all segments differ."""
        n_seg = len(sizes)
        self.depth, self.sizes = depth, sizes
        ends = np.cumsum(sizes + 1) - 1  # places of the terminators
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data.astype(np.int64) + 1
        seg = np.repeat(np.arange(n_seg), sizes + 1)
        left = ends[seg] - np.arange(n)  # characters before the terminator
        # suffixes in order; terminators differ, a lower segment number comes first
        packed = np.zeros(n, np.int64)
        for k in range(7):
            c = np.zeros(n, np.int64)
            c[: n - k] = text[k:]
            packed = packed * 512 + np.where(left > k, c, 0)
        # suffixes that end within the first characters differ by their segment: the sort is stable
        rank = self.ranked(np.where(left == 0, seg - n_seg, packed), left < 7)
        # each round takes the ranks at two further places if three fit one integer, else at one
        h, part, first, m = 7, 7, rank, n + n_seg + 1  # first: ranks by the first ``part`` characters, at most ``depth``
        steps = 2 if m < self.THREE else 1
        while h <= int(sizes.max()):
            keys = rank.copy()
            for k in range(1, steps + 1):
                ahead = np.zeros(n, np.int64)
                at = min(k * h, n)
                ahead[: n - at] = rank[at:] + n_seg
                keys *= m
                keys += np.where(left >= k * h, ahead, seg)
            rank = self.ranked(keys)
            h *= steps + 1
            if h <= depth:
                part, first = h, rank
        del packed
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)  # ranks are all different now
        # runs of the transform, also cut between strings that differ within ``depth``
        bwt = np.where(order > 0, text[order - 1], 0)
        a, b = order[:-1], order[1:]
        long = left >= depth
        same = long[a] & long[b]
        for k in [*range(0, depth - part, part), depth - part]:
            same &= first[np.minimum(a + k, n - 1)] == first[np.minimum(b + k, n - 1)]
        interval = np.flatnonzero(np.concatenate(([True], ~same)))
        lowest = np.minimum.reduceat(owners[seg[order]], interval)
        cut = np.concatenate(([True], ~same | (bwt[1:] != bwt[:-1])))
        self.start = np.flatnonzero(cut)
        self.char = bwt[self.start]
        length = np.diff(np.append(self.start, n))
        counts = np.bincount(self.char, weights=length, minlength=258).astype(np.int64)
        counts[0] = 0
        # rows of suffixes that begin with a smaller character: first the terminators
        below = n_seg + np.concatenate(([0], np.cumsum(counts)[:-1]))
        by = np.argsort(self.char, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        head = np.searchsorted(self.char[by], np.arange(258))
        base = np.append(before, n)[head]
        self.to = np.empty(len(by), np.int64)
        self.to[by] = below[self.char[by]] + before - base[self.char[by]]
        self.sample = lowest[np.searchsorted(interval, self.start, side="right") - 1]

    @staticmethod
    def ranked(keys: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
        """Dense ranks; equal keys share one unless they are ``apart``."""
        order = np.argsort(keys, kind=None if apart is None else "stable")
        sorted_keys = keys[order]
        rank = np.empty(len(keys), np.int64)
        step = sorted_keys[1:] != sorted_keys[:-1]
        if apart is not None:
            step |= apart[order][1:]
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        return rank

    def smallest_owners(self) -> np.ndarray:
        """For each segment in turn and each place with ``depth`` bytes ahead: the smallest owner of that string."""
        n_out = self.sizes - self.depth + 1
        at = np.cumsum(n_out) - n_out
        out = np.empty(int(n_out.sum()), np.int64)
        live = np.arange(len(self.sizes))
        row = live.copy()  # the suffix that is only segment j's terminator has rank j
        for step in range(int(self.sizes.max()) + 1):
            run = np.searchsorted(self.start, row, side="right") - 1
            if step >= self.depth:
                out[at[live] + self.sizes[live] - step] = self.sample[run]
            go = self.sizes[live] > step
            live, row, run = live[go], row[go], run[go]
            row = self.to[run] + row - self.start[run]
        return out
