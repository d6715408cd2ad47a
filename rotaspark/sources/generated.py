"""Seeded matrices and vectors as lazy DataFrames.

A matrix is (row, pos, col, val): pos 0 is the diagonal, then the off-diagonal
entries in the order of their walk; rows have unit length.  Every row is a
function of its number, so generation is a map: the pattern's closed form cuts
the rows into ranges of about equally many nonzeros, one a task, and a task
computes its rows a batch of entries at a time, each entry once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.functions.bits import MASK, drawn, mixed, units
from rotaspark.plans.pattern import Pattern

SEED = 111
#: Mixed into the seed for the initial vector (fixed value).
VECTOR_SEED = 0x123456789ABCDEF0
#: Entries of a task at most (but for a longer row), and entries computed at a time.
TASK_ENTRIES, BATCH_ENTRIES = 4_000_000, 1 << 18


def strides(raw: np.ndarray, n: int) -> np.ndarray:
    """For each draw a step prime to n near raw % n, odd if it can be."""
    if n == 1:
        return np.ones(len(raw), np.int64)
    s = np.maximum(raw % np.uint64(n), 1).astype(np.int64)
    even = s % 2 == 0
    s[even] = np.where(s[even] + 1 < n, s[even] + 1, 1)
    while (left := np.flatnonzero(np.gcd(s, n) != 1)).size:
        s[left] = np.where(s[left] + 2 < n, s[left] + 2, 1)
    return s


class Rows:
    """Rows [first, last) of a generated matrix: where each walk starts, its step and the draws' seeds."""

    def __init__(self, first: int, last: int, n: int, seed: int):
        self.n, self.rows = n, np.arange(first, last)
        self.seeds = np.uint64(seed & MASK) ^ mixed(self.rows.astype(np.uint64) + np.uint64(1))
        self.start = (drawn(self.seeds, np.uint64(2)) % np.uint64(n)).astype(np.int64)
        self.step = strides(drawn(self.seeds, np.uint64(3)), n)

    def columns(self, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Column at step t of row r's walk; below n**2, so unsigned numbers hold it."""
        walk = self.start[r].astype(np.uint64) + t.astype(np.uint64) * self.step[r].astype(np.uint64)
        return (walk % np.uint64(self.n)).astype(np.int64)

    def values(self, r: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Values before the rows are scaled."""
        draw = np.where(pos == 0, 1, pos + 3).astype(np.uint64)
        return 0.1 + 0.9 * units(drawn(self.seeds[r], draw)) + (pos == 0)


def _short_rows(rows: Rows, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    begins = np.cumsum(sizes) - sizes
    r = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(r)) - begins[r]
    walk = rows.columns(r, pos)
    # The walk meets the row's own column once at most; without that step, or else the last one, size - 1 are left.
    skipped = sizes - 1
    own = np.flatnonzero(walk == rows.rows[r])
    skipped[r[own]] = pos[own]
    col = rows.rows[r].copy()
    col[pos > 0] = walk[pos != skipped[r]]
    val = rows.values(r, pos)
    val *= (1 / np.sqrt(np.add.reduceat(val * val, begins)))[r]
    return rows.rows[r], pos, col, val


def _long_row(rows: Rows, size: int, batch: int) -> Iterator[tuple[np.ndarray, ...]]:
    """One row a batch of entries at a time: first its length and the step that is left out, then the entries."""
    length, skipped = 0.0, size - 1
    parts = [np.arange(a, min(size, a + batch)) for a in range(0, size, batch)]
    for pos in parts:
        r = np.zeros(len(pos), np.int64)
        own = np.flatnonzero(rows.columns(r, pos) == rows.rows[0])
        skipped = int(pos[own[0]]) if len(own) else skipped
        val = rows.values(r, pos)
        length += float(val @ val)
    for pos in parts:
        r = np.zeros(len(pos), np.int64)
        t = pos - 1 + (pos - 1 >= skipped)
        col = np.where(pos == 0, rows.rows[0], rows.columns(r, np.maximum(t, 0)))
        yield rows.rows[r], pos, col, rows.values(r, pos) * (1 / np.sqrt(length))


def entries(first: int, last: int, pattern: Pattern, seed: int, batch: int = BATCH_ENTRIES) -> Iterator[tuple[np.ndarray, ...]]:
    """row, pos, col, val of the rows [first, last), about `batch` entries at a time."""
    at = first
    while at < last:
        to = min(last, max(at + 1, pattern.first_row_with(pattern.row_ptr(at) + batch)))
        if to > at + 1 and pattern.nnz(to - 1) > batch:
            to -= 1
        sizes = np.diff(pattern.row_ptr(np.arange(at, to + 1)))
        rows = Rows(at, to, pattern.n, seed)
        if to == at + 1 and sizes[0] > batch:
            yield from _long_row(rows, int(sizes[0]), batch)
        else:
            yield _short_rows(rows, sizes)
        at = to


def matrix(spark: SparkSession, n: int, nz: int, mode: str = "irregular", seed: int = SEED) -> DataFrame:
    """row, pos, col, val."""
    pattern = Pattern(n, nz, mode)
    parts = min(n, max(spark.sparkContext.defaultParallelism, -(-nz // TASK_ENTRIES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                last = n if t + 1 == parts else pattern.first_row_with(nz * (t + 1) // parts)
                for columns in entries(pattern.first_row_with(nz * t // parts), last, pattern, seed):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "pos", "col", "val"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "row long, pos long, col long, val double")


def row_pointers(spark: SparkSession, n: int, nz: int, mode: str = "irregular") -> DataFrame:
    """row, ptr for the rows 0 to n."""
    return spark.range(n + 1).select(F.col("id").alias("row"), Pattern(n, nz, mode).row_ptr(F.col("id")).cast("long").alias("ptr"))


def pattern_counts(spark: SparkSession, n: int, nz: int, mode: str = "irregular") -> DataFrame:
    """row, k: the nonzeros of each row, without generating them."""
    return spark.range(n).select(F.col("id").alias("row"), Pattern(n, nz, mode).nnz(F.col("id")).cast("long").alias("k"))


def matrix_stats(counts: DataFrame, n: int, nz: int | None = None) -> DataFrame:
    """rows, total_nnz, min_nnz, max_nnz, avg_nnz (3 places) of (row, k); fails where the total is not nz."""
    stats = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), F.min("k").alias("least"), F.max("k").alias("max_nnz"), F.count(F.lit(1)).alias("some"))
    total = F.col("total")
    if nz is not None:
        said = F.concat(F.lit(f"the rows should hold {nz} nonzeros and hold "), F.col("total").cast("string"))
        total = F.when(F.col("total") == nz, F.col("total")).otherwise(F.raise_error(said).cast("long"))
    return stats.select(F.lit(n).cast("long").alias("rows"), total.alias("total_nnz"), F.when(F.col("some") < n, 0).otherwise(F.col("least")).cast("long").alias("min_nnz"), "max_nnz", F.round(F.col("total") / n, 3).alias("avg_nnz"))


def row_counts(entries: DataFrame) -> DataFrame:
    """row, k of any (row, ...) entries; rows without entries are left out."""
    return entries.groupBy("row").agg(F.count(F.lit(1)).alias("k"))


def raw_vector(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """i, v: draws in [0, 1) before they are normalised."""
    start = np.uint64((seed ^ VECTOR_SEED) & MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units(drawn(start, i.astype(np.uint64) + np.uint64(1))))], ["i", "v"])

    return spark.range(n).mapInArrow(run, "i long, v double")
