"""Words of many texts at once: boundaries and hashes by array operations, distinct words by a hash table.

A text's characters become one array.  The differences of a running sum of
coded characters give every word's polynomial hash, whatever its length, so
repeated words are found without cutting them out of the text.  Two
independent 64-bit hashes tell words apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` places."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def coded(n_codes: int, seed: int) -> np.ndarray:
    """Two random 64-bit numbers for each character code."""
    return np.random.default_rng(seed).integers(0, _MASK, (2, n_codes), np.uint64, endpoint=True)


class Runs:
    """Hashes of runs of one array of characters; ``values`` are the two numbers of each character."""

    def __init__(self, values: np.ndarray) -> None:
        n = values.shape[1]
        power, self._inverse = _power_tables(n)
        self._totals = np.zeros((2, n + 1), np.uint64)
        np.cumsum(values * power[:n], axis=1, out=self._totals[:, 1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of each run; equal runs have equal hashes wherever they stand."""
        total = self._totals[which]
        return (total[ends] - total[starts]) * self._inverse[starts]

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all runs: the first run equal to each distinct one, in order, and which distinct one each run is."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        one, two = (self.hashes(starts, ends, k) for k in (0, 1))
        of = pa.array(one).dictionary_encode().indices.to_numpy()
        so_far = np.maximum.accumulate(of)
        first = np.flatnonzero(np.concatenate(([True], of[1:] > so_far[:-1])))
        if (two[first][of] != two).any():  # two words with one first hash
            _, first, of = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
        return first, of
