"""Hashes of the words of many texts, computed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: hashes, starts in the joined bytes, text numbers; and the joined bytes.

    A hash is a sum over a word's bytes of a mix of byte and place.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, start, data
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=np.int64)
        place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
        units = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MUL
        units ^= units >> np.uint64(29)
        units *= np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units)))
        hashes = scrambled(sums[end] - sums[start] + (end - start).astype(np.uint64))
    return hashes, start, np.searchsorted(ends, start, side="right"), data


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of texts of about ``size`` bytes, each with the number of its first text."""
    first, group, total = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t)
        total += len(t)
        if total > size:
            yield first, group
            first, group, total = i + 1, [], 0
    if group:
        yield first, group
