"""Order statistics of a growing history in sorted blocks: percentiles and clipped moments without reading the history."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


class SortedBlocks:
    """Values in ascending blocks with an index of them: least value, count, sum and sum of squares of each.

    `load` fetches a block by its number when it is first needed; blocks that change are kept in `changed` until they are
    stored. Blocks with a number below 0 are closed: only their sums are known, and no rank that is asked for may lie in
    them. A value costs a look at the index (one entry for a few hundred values) and at three blocks, however long the
    history. Sums of a block are taken anew from its values at each change, so that rounding errors can't add up.
    """

    SIZE = 256

    def __init__(self, load: Callable[[int], np.ndarray] | None = None, index: np.ndarray | None = None):
        self.load = load
        #: Columns: number of the block, least value, count, sum, sum of squares.
        self.index = np.empty((0, 5)) if index is None else index
        self.held: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def __len__(self) -> int:
        return int(self.index[:, 2].sum())

    def block(self, at: int) -> np.ndarray:
        number = int(self.index[at, 0])
        if number not in self.held:
            self.held[number] = self.load(number)
        return self.held[number]

    @staticmethod
    def entry(number: int, values: np.ndarray) -> list[float]:
        return [number, values[0], len(values), values.sum(), (values * values).sum()]

    def add(self, value: float) -> None:
        if not len(self.index):
            self.held[0] = np.array([value])
            self.index = np.array([self.entry(0, self.held[0])])
            self.changed.add(0)
            return
        at = max(0, int(np.searchsorted(self.index[:, 1], value, side="right")) - 1)
        number = int(self.index[at, 0])
        if number < 0:
            self.index[at] += [0, 0, 1, value, value * value]
            self.index[at, 1] = min(self.index[at, 1], value)
            return
        values = self.block(at)
        values = np.insert(values, np.searchsorted(values, value), value)
        if len(values) > 2 * self.SIZE:
            fresh = int(self.index[:, 0].max()) + 1
            self.held[fresh], values = values[self.SIZE :], values[: self.SIZE]
            self.changed.add(fresh)
            self.index = np.insert(self.index, at + 1, self.entry(fresh, self.held[fresh]), axis=0)
        self.held[number] = values
        self.changed.add(number)
        self.index[at] = self.entry(number, values)

    def _split(self, rank: int) -> tuple[int, int]:
        """Block and place of the value with this rank (from 0)."""
        before = np.concatenate([[0], self.index[:, 2].cumsum()])
        at = min(int(np.searchsorted(before, rank, side="right")) - 1, len(self.index) - 1)
        return at, rank - int(before[at])

    def _below(self, rank: int) -> tuple[float, float]:
        """Sum and sum of squares of the values with ranks below this one."""
        if rank >= len(self):
            return float(self.index[:, 3].sum()), float(self.index[:, 4].sum())
        at, place = self._split(rank)
        part = self.block(at)[:place]
        return float(self.index[:at, 3].sum() + part.sum()), float(self.index[:at, 4].sum() + (part * part).sum())

    def percentile(self, p: float) -> float:
        """Linear between neighbouring ranks."""
        place = p * (len(self) - 1)
        at, inside = self._split(int(place))
        low = self.block(at)[inside]
        if place == int(place):
            return float(low)
        at, inside = self._split(int(place) + 1)
        return float(low + (place - int(place)) * (self.block(at)[inside] - low))

    def clipped(self, lo: float, hi: float) -> tuple[float, float, float, float]:
        """Both percentiles, and mean and deviation of all values clipped to them."""
        n = len(self)
        low, high = self.percentile(lo), self.percentile(hi)
        n_low, n_high = int(lo * (n - 1)) + 1, n - 1 - int(hi * (n - 1))
        (s1, q1), (s2, q2) = self._below(n_low), self._below(n - n_high)
        mean = (n_low * low + (s2 - s1) + n_high * high) / n
        second = (n_low * low * low + (q2 - q1) + n_high * high * high) / n
        return low, high, mean, math.sqrt(max(0.0, second - mean * mean)) if high > low else 0.0


def winsor_z_next(history: SortedBlocks, value: float, warmup: int, lo: float = 0.01, hi: float = 0.99, shift: float = 0.0) -> float | None:
    """Take the value into the history (less the shift) and score it; None where it isn't finite or the history is short."""
    if not math.isfinite(value):
        return None
    v = value - shift
    history.add(v)
    if len(history) < warmup:
        return None
    low, high, mean, sd = history.clipped(lo, hi)
    return (min(max(v, low), high) - mean) / (sd if sd > 0 else 1.0)
