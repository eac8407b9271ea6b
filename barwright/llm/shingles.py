"""Word shingles of whole texts as 64-bit hashes, whole batches of texts at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_Q = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) | 1 for j in range(16)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time.
WINDOW = 1 << 15
#: What a byte adds to its word: one more than itself, in lower case if asked for, and nothing for white space.
_VALUE = {lower: np.where(_SPACE, 0, (_LOWER if lower else np.arange(256)).astype(np.int64) + 1).astype(np.uint64) for lower in (True, False)}
_FACTOR, _INVERSE = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW - 1, f, np.uint64)])) for f in (_P, pow(_P, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(buffer: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word (run of other than white space) of a byte buffer.

    A word's hash is a sum over its bytes, each times a power of a fixed number
    by its place, so the buffer is read in windows and a word that a window
    cuts adds up over several; no table grows with the text.
    """
    starts, sums, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    open_ = False  # the last word may go on
    for lo in range(0, len(buffer), WINDOW):
        part = buffer[lo : lo + WINDOW]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0] * int(inside[0]), edge, [len(part)] * int(inside[-1])]).astype(np.int64)
        start, length = edge[::2], edge[1::2] - edge[::2]
        if not len(start):
            open_ = False
            continue
        total = np.add.reduceat(_VALUE[lower][part] * _FACTOR[: len(part)], start) * _INVERSE[start]
        if open_ and inside[0]:
            sums[-1][-1:] += total[:1] * _U(pow(_P, int(lengths[-1][-1]), 1 << 64))
            lengths[-1][-1:] += length[:1]
            start, total, length = start[1:], total[1:], length[1:]
        open_ = bool(inside[-1])
        if len(start):
            starts.append(start + lo)
            sums.append(total)
            lengths.append(length)
    return np.concatenate(starts), mixed(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64) * _U(_P))


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles in ascending order; a text with fewer words is one shingle, none gives none."""
    blobs = [(t or "").encode() for t in texts]
    at = np.cumsum([0] + [len(b) + 1 for b in blobs])
    start, word = word_hashes(np.frombuffer(b" ".join(blobs) + b" ", np.uint8))
    first = np.searchsorted(start, at)
    n = len(word) - width + 1
    if n > 0:
        every = word[:n] * _Q[0]
        for j in range(1, width):
            every += word[j : j + n] * _Q[j]
        every = mixed(every)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(every[lo : hi - width + 1])
        elif hi > lo:
            w = word[lo:hi]
            yield mixed((w * _Q[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + _U(int(hi - lo) * 0xA24BAED4963EE407 & _ALL))
        else:
            yield np.zeros(0, np.uint64)
