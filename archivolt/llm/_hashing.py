"""Vectorised hashes of bytes, words and word sequences, all modulo 2^64.

A sequence x[0..n) has the key sum(x[i] * m^i). With the odd m, prefix sums
give the key of any stretch: (prefix[end] - prefix[start]) * m^-start. Byte
values are replaced by random 64-bit values first, word keys are mixed before
they enter a sequence, so equal keys mean equal content but for chance of the
order of 2^-64; callers that decide on content use two keys or compare it.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
BYTE_MULTIPLIER = 0x9E3779B97F4A7C15
SEQUENCE_MULTIPLIERS = (0xD1342543DE82EF95, 0xAEF17502108EF2D9)
MASK = (1 << 64) - 1
PIECE = 1 << 20


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@functools.lru_cache(maxsize=8)
def _powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(m: int) -> np.ndarray:
        out = np.full(size, m, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(multiplier), run(pow(multiplier, -1, 1 << 64))


def powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """m^i and m^-i for i < size; tables are kept by powers of two of the size."""
    grown = 1 << max(12, int(size - 1).bit_length())
    up, down = _powers(multiplier, grown)
    return up[:size], down[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Sequences:
    """Keys of stretches of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, multiplier: int):
        self.up, self.down = powers(multiplier, len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self.up[:-1], out=self.prefix[1:])

    def key(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        """Keys of all stretches of ``width`` values, by their start."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.empty(0, dtype=U64)
        return (self.prefix[width:] - self.prefix[:n]) * self.down[:n]


def word_keys(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of each maximal run of bytes b with is_word[b].

    Long inputs are taken in pieces cut between words, so that memory does not
    follow the length of a text.
    """
    array = np.frombuffer(data, dtype=np.uint8)
    keys, starts, ends, at = [], [], [], 0
    while at < len(array):
        stop = min(len(array), at + PIECE)
        if stop < len(array):
            gaps = np.flatnonzero(~is_word[array[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~is_word[array[stop:]])
                stop = stop + int(rest[0]) + 1 if len(rest) else len(array)
        piece = array[at:stop]
        inside = np.zeros(len(piece) + 2, dtype=np.int8)
        inside[1:-1] = is_word[piece]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            sums = Sequences(byte_values()[piece], BYTE_MULTIPLIER)
            keys.append(mix(sums.key(start, end) ^ (end - start).astype(U64)))
            starts.append(start + at)
            ends.append(end + at)
        at = stop
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(ends)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of ``width`` values."""
    n = len(values)
    best, place, span = values, np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        place = np.where(take, place[step:], place[: len(place) - step])
        best = np.where(take, right, left)
        span += step
    return place
