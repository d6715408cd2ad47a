"""Scaling metrics as column functions; a missing or non-positive time gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_NONZERO = 12
#: Guard of the relative difference's denominator (fixed value).
TINY = 1e-300


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / b)


def speedup(seq: Column, time: Column) -> Column:
    return ratio(seq, time)


def efficiency(sp: Column, workers: Column) -> Column:
    return ratio(sp, workers)


def karp_flatt(sp: Column, workers: Column) -> Column:
    """(1/S - 1/p) / (1 - 1/p) for p > 1."""
    return F.when((workers > 1) & (sp > 0), (1 / sp - 1 / workers) / (1 - 1 / workers))


def bandwidth(nz: Column, time: Column, iterations: int = 500) -> Column:
    """GB/s of the matrix stream over all iterations."""
    return F.when(time > 0, F.lit(float(iterations * BYTES_PER_NONZERO)) * nz / time / 1e9)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.lit(TINY))


def spread_percent(low: Column, high: Column) -> Column:
    return F.when(low > 0, 100 * (high - low) / low)


def density(nz: Column, n: Column) -> Column:
    return F.round(nz / n, 1)
