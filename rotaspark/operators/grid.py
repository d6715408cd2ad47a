"""Products with a matrix in two-dimensional blocks that is written once and never moved again.

Rows and columns are cut into ranges of about equally many entries.  The entries
of a pair of ranges are packed and written to a table bucketed by that pair, in the
folder the session shares.  A product sends each range of the vector to the blocks
of its columns, where Spark joins it to their buckets in place, and sends the blocks'
sums to the ranges of the vector they belong to after the rotation.  Only pieces of
the vector travel: about (row ranges + column ranges) x n numbers a product.

Tasks stream: one holds a range of the vector and a piece of a block at a time.
Sums are added in the order of the blocks, so that a grid gives the same bits again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaspark.operators.linear import exact_sums
from rotaspark.plans.schedule import part_bounds
from rotaspark.sources.scratch import delete, shared_dir

#: Entries of a block (about), entries of a record, rows of a range of the vector at most (8 bytes each).
BLOCK_ENTRIES, RECORD_ENTRIES, RANGE_ROWS = 4_000_000, 1_000_000, 4_000_000
#: Blocks a core at least, so that buckets with two do not hold up a product; Spark's bound on buckets.  Beyond it blocks grow, in records of one size.
BLOCKS_A_CORE, MOST_BLOCKS = 2, 100_000

BLOCK = "c int, r int, k int, rows binary, heads binary, cols binary, vals binary"
PIECE = "c int, data binary"
SUMS = "c int, source long, k int, at binary, data binary"


def _counts(a: DataFrame, side: str, n: int) -> DataFrame:
    every = a.sparkSession.range(n).select(F.col("id").alias("at"))
    return every.join(a.groupBy(F.col(side).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("k")), "at", "left").select("at", F.coalesce("k", F.lit(0)).alias("k"))


def _changes(*columns: np.ndarray) -> list[int]:
    """Where a run of equal rows begins, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), len(new)] if len(new) else [0]


class Grid:
    """A square matrix (row, col, val) of n rows, in blocks."""

    def __init__(self, a: DataFrame, n: int, sides: tuple[int, int] | None = None):
        """sides: ranges of rows and of columns; found from the number of entries if not given."""
        self.spark, self.n = a.sparkSession, n
        if sides is None:
            blocks = min(MOST_BLOCKS, max(BLOCKS_A_CORE * self.spark.sparkContext.defaultParallelism, a.count() // BLOCK_ENTRIES))
            columns = max(math.isqrt(blocks), -(-n // RANGE_ROWS))
            sides = max(1, blocks // columns), columns
        self.rows, self.columns = (part_bounds(_counts(a, side, n), "at", "k", parts, n) for side, parts in zip(("row", "col"), sides))
        self.ranges, self.buckets = len(self.columns) - 1, (len(self.rows) - 1) * (len(self.columns) - 1)
        self.name, self.path = f"grid_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/grid-{uuid.uuid4().hex}"
        self._write(a)

    def _write(self, a: DataFrame) -> None:
        rows, columns = self.rows, self.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r, c = (np.searchsorted(b, x, "right") - 1 for b, x in ((rows, batch.column(0)), (columns, batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(r, pa.int32()), *batch.columns], ["c", "r", "row", "col", "val"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sorted entries to records of one block each."""
            held: list[pa.RecordBatch] = []
            block, count, k = None, 0, 0

            def record() -> pa.RecordBatch:
                row, col, val = (pa.Table.from_batches(held)[c].to_numpy() for c in ("row", "col", "val"))
                heads = np.array(_changes(row)[:-1])
                parts = (row[heads], heads, (col - columns[block[0]]).astype(np.int32), val)
                return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (*block, k)] + [pa.array([x.tobytes()], pa.binary()) for x in parts], ["c", "r", "k", "rows", "heads", "cols", "vals"])

            for batch in batches:
                c, r = (batch.column(i).to_numpy() for i in (0, 1))
                edges = _changes(c, r)
                for low, high in zip(edges, edges[1:]):
                    here = (int(c[low]), int(r[low]))
                    if held and (here != block or count >= RECORD_ENTRIES):
                        yield record()
                        held, count, k = [], 0, k + 1 if here == block else 0
                    block = here
                    held.append(batch.slice(low, high - low))
                    count += high - low
            if held:
                yield record()

        entries = a.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
        dealt = entries.mapInArrow(place, "c int, r int, row long, col long, val double").repartition(self.buckets, "c", "r")
        packed = dealt.sortWithinPartitions("c", "r", "row", "col").mapInArrow(pack, BLOCK)
        packed.write.bucketBy(self.buckets, "c", "r").option("path", self.path).format("parquet").saveAsTable(self.name)

    def pieces(self, x: DataFrame) -> DataFrame:
        """c, data: the ranges of a vector (i, v); ranges without elements are left out."""
        columns = self.columns

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(columns, batch.column(0), "right") - 1, pa.int32()), *batch.columns], ["c", "i", "v"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def single() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for batch in batches:
                    c, i, v = (x.to_numpy() for x in batch.columns)
                    edges = _changes(c)
                    yield from ((int(c[low]), i[low:high] - columns[c[low]], v[low:high]) for low, high in zip(edges, edges[1:]))

            yield from _filled(single(), columns)

        given = x.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
        dealt = given.mapInArrow(cut, "c int, i long, v double").repartition(self.ranges, "c").sortWithinPartitions("c")
        return dealt.mapInArrow(fill, PIECE)

    def product(self, pieces: DataFrame, shift: int = 0, scale: float = 1.0) -> DataFrame:
        """The ranges of scale * shift(A) x."""
        n, columns, down = self.n, self.columns, len(self.rows) - 1

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, r, k, rows, heads, cols, vals, data in zip(*(x.to_pylist() for x in batch.columns)):
                    x = np.frombuffer(data) * scale
                    sums = np.add.reduceat(np.frombuffer(vals) * x[np.frombuffer(cols, np.int32)], np.frombuffer(heads, np.int64))
                    at = (np.frombuffer(rows, np.int64) + shift) % n
                    order = np.argsort(at, kind="stable")
                    at, sums = at[order], sums[order]
                    to = np.searchsorted(columns, at, "right") - 1
                    edges = _changes(to)
                    for low, high in zip(edges, edges[1:]):
                        parts = (at[low:high] - columns[to[low]], sums[low:high])
                        yield pa.RecordBatch.from_arrays([pa.array([to[low]], pa.int32()), pa.array([c * down + r], pa.int64()), pa.array([k], pa.int32())] + [pa.array([p.tobytes()], pa.binary()) for p in parts], ["c", "source", "k", "at", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def single() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for batch in batches:
                    yield from ((c, np.frombuffer(at, np.int64), np.frombuffer(data)) for c, at, data in zip(*(x.to_pylist() for x in batch.columns)))

            yield from _filled(single(), columns)

        sent = pieces.select("c", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), "data").hint("shuffle_hash")
        met = self.spark.table(self.name).join(sent, ["c", "r"]).select("c", "r", "k", "rows", "heads", "cols", "vals", "data")
        sums = met.mapInArrow(multiply, SUMS).repartition(self.ranges, "c").sortWithinPartitions("c", "source", "k")
        return sums.select("c", "at", "data").mapInArrow(add, PIECE)

    def vector(self, pieces: DataFrame, scale: float = 1.0) -> DataFrame:
        """i, v of ranges times scale."""
        columns = self.columns

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, data in zip(*(x.to_pylist() for x in batch.columns)):
                    v = np.frombuffer(data) * scale
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns[c], columns[c] + len(v))), pa.array(v)], ["i", "v"])

        return pieces.select("c", "data").mapInArrow(spread, "i long, v double")

    def length(self, pieces: DataFrame) -> float:
        """The length of a vector given by its ranges; sums of ranges are added without error."""

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sum(np.frombuffer(d) ** 2)) for d in batch.column(0).to_pylist()], pa.float64())], ["s"])

        total = exact_sums(pieces.select("data").mapInArrow(squares, "s double"), "s").first().total
        return math.sqrt(total or 0.0)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _filled(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts (range, places in it, values), in the order of ranges, added up to whole ranges."""
    now, total = None, np.empty(0)
    record = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["c", "data"])
    for c, at, values in parts:
        if c != now:
            if now is not None:
                yield record()
            now, total = c, np.zeros(columns[c + 1] - columns[c])
        total[at] += values
    if now is not None:
        yield record()
