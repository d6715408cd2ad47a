"""How many nonzeros each row of a generated matrix has, in closed form.

A row's weight depends on its number alone, so rows fall into six classes whose
members below any row can be counted by arithmetic.  Floor shares, remainders
by rank, the fill of what capped rows leave, and the running total of nonzeros
are therefore expressions of the row number: no sort, no window, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("regular", "irregular")


def least(a, b):
    """The smaller of two ints, arrays or columns."""
    if isinstance(a, Column) or isinstance(b, Column):
        return F.least(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])
    return np.minimum(a, b) if isinstance(a, np.ndarray) or isinstance(b, np.ndarray) else min(a, b)


def greatest(a, b):
    return -least(-a, -b)


def floored(a, by: int):
    return F.floor(a / by) if isinstance(a, Column) else a // by


def validate(n: int, nz: int, mode: str) -> None:
    """Raises ValueError for a shape or mode that has no matrix."""
    if n <= 0:
        raise ValueError("n must be positive")
    if n > 2**32 - 1:
        raise ValueError("n must fit in 32 bits")
    if nz < n:
        raise ValueError("nz must be at least n")
    if nz > n * n:
        raise ValueError("nz must be at most n * n")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


@dataclass(frozen=True)
class Class:
    """Rows of [low, high) whose number modulo 16 is in [first, last)."""

    weight: int
    low: int
    high: int
    first: int
    last: int

    def below(self, i):
        """Members below row i."""
        wide = self.last - self.first

        def count(x):  # numbers below x with a remainder in [first, last)
            return floored(x, 16) * wide + least(greatest(x % 16 - self.first, 0), wide)

        return count(least(greatest(i, self.low), self.high)) - count(self.low)

    @property
    def size(self) -> int:
        return self.below(self.high)

    def has(self, i: Column) -> Column:
        return (i >= self.low) & (i < self.high) & (i % 16 >= self.first) & (i % 16 < self.last)


def classes(n: int) -> list[Class]:
    """Band ends n/10, n/4, 3n/5; weights 40 (160 where i%16 < 2), 10 (20 where i%16 = 0), 3, 1."""
    a, b, c = n // 10, n // 4, 3 * n // 5
    return [Class(160, 0, a, 0, 2), Class(40, 0, a, 2, 16), Class(20, a, b, 0, 1), Class(10, a, b, 1, 16), Class(3, b, c, 0, 16), Class(1, c, n, 0, 16)]


class Pattern:
    """nnz(i) and row_ptr(i) for row numbers given as ints, arrays or columns."""

    def __init__(self, n: int, nz: int, mode: str = "irregular"):
        validate(n, nz, mode)
        self.n, self.nz, self.mode = n, nz, mode
        if mode == "regular":
            self.base, self.rest = divmod(nz, n)
            return
        self.parts = [c for c in classes(n) if c.size]
        extras, total = nz - n, sum(c.weight * c.size for c in self.parts)
        ideal = [np.longdouble(extras) * np.longdouble(c.weight) / np.longdouble(total) for c in self.parts]
        share = [min(int(np.floor(x)), n - 1) for x in ideal]
        self.own = [1 + s for s in share]
        left = extras - sum(s * c.size for s, c in zip(share, self.parts))
        # Leftover units go by remainder, largest first; classes with one remainder take turns by row number.
        ranked: dict[np.longdouble, list[int]] = {}
        for k, (x, s) in enumerate(zip(ideal, share)):
            if s < n - 1:
                ranked.setdefault(x - np.floor(x), []).append(k)
        self.takes: list[tuple[list[int], int]] = []
        for frac in sorted(ranked, reverse=True):
            members = ranked[frac]
            units = min(left, sum(self.parts[k].size for k in members))
            if units:
                self.takes.append((members, units))
            left -= units
        self.left = left  # filled from row 0 up

    def _taken_before(self, i):
        """Rows below i that got a leftover unit."""
        total = i * 0
        for members, units in self.takes:
            before = sum((self.parts[k].below(i) for k in members[1:]), self.parts[members[0]].below(i))
            total = total + least(before, units)
        return total

    def _before_fill(self, i):
        """Nonzeros of the rows below i without the fill."""
        own = sum((c.below(i) * k for c, k in zip(self.parts[1:], self.own[1:])), self.parts[0].below(i) * self.own[0])
        return own + self._taken_before(i)

    def row_ptr(self, i):
        """Nonzeros of all rows below i."""
        if self.mode == "regular":
            return i * self.base + least(i, self.rest)
        before = self._before_fill(i)
        return before + least(i * self.n - before, self.left)

    def nnz(self, i):
        return self.row_ptr(i + 1) - self.row_ptr(i)

    def first_row_with(self, target: int) -> int:
        """The smallest r with row_ptr(r) >= target, by bisection."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.row_ptr(middle) >= target:
                high = middle
            else:
                low = middle + 1
        return low
