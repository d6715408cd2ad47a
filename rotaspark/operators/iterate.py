"""Power iteration with a matrix whose rows rotate at every epoch.

The matrix is written once; two ways to run the iterations over it:

barrier  one barrier stage for SAVED iterations: a task holds a range of rows with
         about as many entries as the others, and pieces of the vector go round from
         task to task.  For vectors of at most BLOCK_ROWS rows, and TASK_ENTRIES
         entries a task.  Bits of the result do not depend on the number of tasks.
         A lost executor costs the iterations since the vector was written last.
grid     the matrix in blocks of two dimensions, written once; pieces of the vector
         are joined to them in place.  The vector is written to the shared folder
         every WRITTEN iterations.  Takes vectors of any length.

`auto` takes barrier where the bounds are met and all tasks can run at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaspark.operators.grid import Grid
from rotaspark.operators.linear import exact_dot, exact_sums, normalize, spmv, spmv_measured
from rotaspark.operators.ring import Ring
from rotaspark.plans.schedule import EPOCH, ITERATIONS, balanced_parts, final_shift, repartition_by_bounds, shift_at
from rotaspark.sources.scratch import discard, materialize

#: Rows of a vector that every task may hold (two vectors, 8 bytes each), entries that it may (12 bytes each).
BLOCK_ROWS, TASK_ENTRIES = 10_000_000, 50_000_000
#: Entries multiplied, and rows given back, at a time.
BATCH_ENTRIES, BATCH_ROWS = 1 << 20, 100_000
#: Entries of a task at least (but for a smaller matrix): it must be worth its start.
BLOCK_ENTRIES = 100_000
#: Iterations of a barrier stage: what a lost executor costs at most.
SAVED = 250
#: Iterations over a grid between two times the vector is scaled and written: short plans, no overflow.
WRITTEN = 5


@dataclass
class Iterated:
    """The final unit vector (i, v), and one row: rayleigh, final_row_shift."""

    x: DataFrame
    result: DataFrame


def power_iterate(a: DataFrame, x0: DataFrame, n: int, iterations: int = ITERATIONS, epoch: int = EPOCH, strategy: str = "auto", tasks: int | None = None) -> Iterated:
    """iterations times y = shift(A) x, x = y / |y|; a is (row, col, val) and may have (pos)."""
    run = {"auto": None, "grid": _grid, "barrier": _barrier}
    if strategy not in run:
        raise ValueError(f"strategy must be auto, grid or barrier, not {strategy!r}")
    if strategy == "barrier" and n > BLOCK_ROWS:
        raise ValueError(f"n = {n} is beyond the bound of strategy {strategy}")
    a = materialize(a, "matrix")
    if strategy == "auto":
        fixed = a.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
        room = n <= BLOCK_ROWS and a.count() <= TASK_ENTRIES * (tasks or a.sparkSession.sparkContext.defaultParallelism)
        strategy = "barrier" if room and fixed else "grid"
    return run[strategy](a, x0, n, iterations, epoch, tasks)


def unrolled(a: DataFrame, x0: DataFrame, n: int, iterations: int, epoch: int) -> DataFrame:
    """A few iterations as one plan over a, which is written first.

    The norm is taken once, while the last product is written: it is linear in the
    steps before it.
    """
    a, x = materialize(a, "matrix"), x0
    for k in range(iterations - 1):
        x = spmv(a, x, n, shift_at(k, n, epoch))
    if not iterations:
        return normalize(x)
    y, size = spmv_measured(a, x, n, shift_at(iterations - 1, n, epoch))
    return y.withColumn("v", F.col("v") * F.lit(1 / size)) if size > 0 else y


def _grid(a: DataFrame, x0: DataFrame, n: int, iterations: int, epoch: int, tasks: int | None) -> Iterated:
    grid = Grid(a, n, (tasks, tasks) if tasks else None)
    x = materialize(grid.pieces(x0), "power")
    for at in range(0, iterations, WRITTEN):
        before, size = x, grid.length(x)
        for k in range(at, min(at + WRITTEN, iterations)):
            # Sums are linear, so the length is only needed now and then, against overflow.
            x = grid.product(x, shift_at(k, n, epoch), 1 / size if k == at and size > 0 else 1.0)
        x = materialize(x, "power")
        discard(before)
    size = grid.length(x)
    scale = 1 / size if size > 0 else 1.0
    z = materialize(grid.vector(grid.product(x, final_shift(n, iterations, epoch), scale)), "power")
    v = materialize(grid.vector(x, scale), "power")
    discard(x)
    grid.drop()
    value = exact_dot(v, z).select(F.col("dot").alias("rayleigh"), F.lit(final_shift(n, iterations, epoch)).cast("long").alias("final_row_shift"))
    return Iterated(v, value)


class Piece:
    """A task's rows [low, high) of the matrix, of `size` entries, taken in as they come in the order of rows."""

    def __init__(self, low: int, high: int, size: int):
        self.low, self.high = low, high
        self.cols, self.vals = np.empty(size, np.int32), np.empty(size)
        # Rows with entries, and where each begins.
        self.rows, self.heads = np.empty(high - low, np.int32), np.empty(high - low, np.int64)
        self.entries = self.filled = 0

    def add(self, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> None:
        if not len(row):
            return
        last = self.rows[self.filled - 1] if self.filled else -1
        new = np.flatnonzero(np.append(row[0] != last, row[1:] != row[:-1]))
        here, more = slice(self.entries, self.entries + len(row)), slice(self.filled, self.filled + len(new))
        self.cols[here], self.vals[here], self.rows[more], self.heads[more] = col, val, row[new], self.entries + new
        self.entries, self.filled = here.stop, more.stop

    def multiply(self, x: np.ndarray, y: np.ndarray) -> None:
        """y[low:high] = A x, whole rows a time, of about BATCH_ENTRIES entries."""
        y[self.low : self.high] = 0
        heads = self.heads[: self.filled]
        cuts = np.unique(np.append(np.searchsorted(heads, np.arange(0, self.entries, BATCH_ENTRIES)), self.filled)).tolist()
        for first, last in zip(cuts, cuts[1:]):
            begin, end = int(heads[first]), int(heads[last]) if last < self.filled else self.entries
            terms = x[self.cols[begin:end]]
            terms *= self.vals[begin:end]
            y[self.rows[first:last]] = np.add.reduceat(terms, heads[first:last] - begin)


def _barrier(a: DataFrame, x0: DataFrame, n: int, iterations: int, epoch: int, tasks: int | None) -> Iterated:
    spark = a.sparkSession
    counts = a.groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    parts = tasks or max(1, min(a.count() // BLOCK_ENTRIES, spark.sparkContext.defaultParallelism))
    every = spark.range(n).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("k", F.lit(0)).alias("k"))
    spans = balanced_parts(every, "row", "k", parts, n).orderBy("part").collect()
    bounds, sizes = [*[s.lo for s in spans], n], [s.nnz for s in spans]
    pos = F.col("pos") if "pos" in a.columns else F.col("col")
    entries = a.select(F.col("row").cast("long").alias("row"), pos.cast("long").alias("pos"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
    x = x0
    for at in range(0, iterations, SAVED) or [0]:
        last = min(iterations, at + SAVED)
        x = materialize(_stage(entries, x, n, bounds, sizes, at, last, epoch, last == iterations), "power")
    value = exact_sums(x.select((F.col("v") * F.col("z")).alias("t")), "t").select(F.col("total").alias("rayleigh"), F.lit(final_shift(n, iterations, epoch)).cast("long").alias("final_row_shift"))
    return Iterated(x.select("i", "v"), value)


def _stage(entries: DataFrame, x: DataFrame, n: int, bounds: list[int], sizes: list[int], first: int, last: int, epoch: int, product: bool) -> DataFrame:
    """Iterations first to last in one barrier stage: i, v, and z = shift(A) v by the last rotation if product."""
    # The vector comes to the tasks as entries before all others of their rows.
    none = F.lit(-1).cast("long")
    given = x.select(F.col("i").cast("long").alias("row"), none.alias("pos"), none.alias("col"), F.col("v").cast("double").alias("val"))
    dealt = repartition_by_bounds(entries.unionByName(given), "row", bounds).sortWithinPartitions("row", "pos", "col").select("row", "col", "val")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Ring(BarrierTaskContext.get(), bounds) as ring:
            low, high = bounds[ring.rank], bounds[ring.rank + 1]
            piece, x, y = Piece(low, high, sizes[ring.rank]), np.zeros(n), np.zeros(n)
            for batch in batches:
                row, col, val = (c.to_numpy() for c in batch.columns)
                if len(row) and not low <= row[0] <= row[-1] < high:
                    raise ValueError(f"rows {row[0]} to {row[-1]} came to the task of rows {low} to {high - 1}")
                x[row[col < 0]] = val[col < 0]
                piece.add(row[col >= 0], col[col >= 0], val[col >= 0])
            if piece.entries != sizes[ring.rank]:
                raise ValueError(f"{piece.entries} entries came to the task of {sizes[ring.rank]}")
            ring.gather(x)

            def multiply() -> None:
                """y = A x: sums of this task's rows, then those of the others."""
                piece.multiply(x, y)
                ring.gather(y)

            def scale() -> None:
                np.multiply(x, x, out=y)
                size = np.sqrt(np.sum(y))  # over the whole vector in each task, so the same however rows are dealt
                if size > 0:
                    np.multiply(x, 1 / size, out=x)

            if not first:
                scale()
            for k in range(first, last):
                multiply()
                shift = shift_at(k, n, epoch)
                x[shift:], x[:shift] = y[: n - shift], y[n - shift :]
                scale()
            shift = 0
            if product:
                multiply()
                shift = final_shift(n, last, epoch)
            else:
                y = x
        for at in range(low, high, BATCH_ROWS):
            i = np.arange(at, min(high, at + BATCH_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x[i]), pa.array(y[(i - shift) % n])], ["i", "v", "z"])

    # Spark starts a barrier stage again only if a shuffle follows it.
    return dealt.mapInArrow(run, "i long, v double, z double", barrier=True).repartition(len(bounds) - 1, "i")
