"""Pair merges of many short words side by side.

Each word is a row of symbol ids with a row of agenda entries: the place, in
merge order, of the piece that a symbol and its right neighbour form.  In each
round every word merges its first pair in that order, the leftmost of equals.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import pairwise

import numpy as np

_PLACE_BITS = 22
_NONE = (1 << _PLACE_BITS) - 1
_EMPTY = np.iinfo(np.int64).min
_ODD = np.uint64(0x9E3779B97F4A7C15)


class RowMerger:
    """Merges given as ``(left id, right id, merged id)`` in the order in which they are preferred; ids are below a million."""

    #: Words of alike lengths share an array; longer ones are left to the caller.
    WIDTHS = (0, 6, 8, 10, 12, 16, 24)

    def __init__(self, merges: Iterable[tuple[int, int, int, int]]) -> None:
        """``merges`` are left, right and merged id, and the place in merge order."""
        left, right, merged, place = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self._merged = np.zeros(int(place.max()) + 1, np.int32)
        self._merged[place] = merged
        # a slot holds a pair and its place in one number
        self._slots = np.full(1 << max(10, (8 * len(left)).bit_length()), _EMPTY, np.int64)
        keys, last = left << 20 | right, len(self._slots) - 1
        at = self._slot(keys)
        while len(keys):  # a pair whose slot is taken goes to the next one
            free = self._slots[at] == _EMPTY
            self._slots[at[free]] = keys[free] << _PLACE_BITS | place[free]
            held = self._slots[at] >> _PLACE_BITS == keys
            keys, place, at = keys[~held], place[~held], at[~held] + 1 & last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _ODD >> np.uint64(65 - len(self._slots).bit_length())).view(np.int64)

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the piece that two symbols form, or _NONE; a negative symbol makes the key negative, which no slot holds."""
        key = (left.astype(np.int64) << 20 | right).ravel()
        at = self._slot(key)
        found = self._slots[at]
        differs = found >> _PLACE_BITS != key
        out = (found & _NONE).astype(np.int32)
        out[differs] = _NONE
        rest = np.flatnonzero(differs & (found != _EMPTY))
        at = at[rest]
        while len(rest):
            at = at + 1 & len(self._slots) - 1
            found = self._slots[at]
            hit = found >> _PLACE_BITS == key[rest]
            out[rest[hit]] = found[hit] & _NONE
            more = ~hit & (found != _EMPTY)
            rest, at = rest[more], at[more]
        return out.reshape(left.shape)

    def _rows(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(lengths.max()) + 1
        out = np.full((len(lengths), width), -1, np.int32)
        out[np.arange(width) < lengths[:, None]] = codes
        rows, ids, columns = np.arange(len(lengths)), out.copy(), np.arange(width)
        agenda = np.full(ids.shape, _NONE, np.int32)
        agenda[:, :-1] = self._place(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = agenda.argmin(1)
            place = agenda[np.arange(len(rows)), best]
            if (done := place == _NONE).any():
                out[rows[done]] = ids[done]
                rows, ids, agenda, best, place = rows[~done], ids[~done], agenda[~done], best[~done], place[~done]
            each, later = np.arange(len(rows)), columns > best[:, None]
            ids[:, :-1] = np.where(later[:, :-1], ids[:, 1:], ids[:, :-1])
            agenda[:, :-1] = np.where(later[:, :-1], agenda[:, 1:], agenda[:, :-1])
            ids[:, -1], agenda[:, -1] = -1, _NONE
            ids[each, best] = merged = self._merged[place]
            agenda[each, best] = self._place(merged, ids[each, best + 1])
            inner = np.flatnonzero(best)
            agenda[inner, best[inner] - 1] = self._place(ids[inner, best[inner] - 1], merged[inner])
        return out[out >= 0], (out >= 0).sum(1)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> list[bytes | None]:
        """Ids of each word as 32-bit numbers; null for words that aren't ``wanted``, are too long or hold a negative id.

        ``symbols`` holds the symbol ids of all words one after another, ``sizes`` how many each has.
        """
        starts = np.cumsum(sizes) - sizes
        unknown = np.concatenate(([0], np.cumsum(symbols < 0)))
        able = wanted & (sizes > 0) & (sizes <= self.WIDTHS[-1]) & (unknown[starts + sizes] == unknown[starts])
        out: list[bytes | None] = [None] * len(sizes)
        for low, high in pairwise(self.WIDTHS):
            alike = able & (sizes > low) & (sizes <= high)
            if not alike.any():
                continue
            flat, counts = self._rows(symbols[np.repeat(alike, sizes)], sizes[alike])
            data, start = flat.tobytes(), 0
            for i, end in zip(np.flatnonzero(alike).tolist(), (4 * np.cumsum(counts)).tolist(), strict=True):
                out[i] = data[start:end]
                start = end
        return out
