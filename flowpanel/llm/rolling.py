"""Hashes of all substrings of a buffer from running sums, and sliding extremes."""

from __future__ import annotations

import numpy as np

from flowpanel.llm.common import mix64

_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 1 << 63, size=512, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Hashes:
    """64-bit hashes of the substrings of one buffer of small numbers (bytes, or bytes plus one)."""

    _powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers[0]) < n + 1:
            with np.errstate(over="ignore"):
                up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
                down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]), dtype=np.uint64)
            Hashes._powers = up, down
        self.up = Hashes._powers[0]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(CODES[data] * Hashes._powers[1][:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of `length`."""
        m = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix64((self.sums[length:] - self.sums[:m]) * self.up[:m] + np.uint64(length))


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over a[i : i + width] for every i with a whole window."""
    out, have = a, 1
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out
