"""Generated matrices and vectors as data sources.

    register(spark)
    spark.read.format("generated_matrix").options(n=1000, nz=20000).load()
    spark.read.format("generated_vector").options(n=1000).load()

Options: n, nz (matrix only), mode (regular or irregular), seed, entries (of a
partition, about).  Partitions are ranges of rows with about as many entries.
Comparisons of the row with numbers are taken by the source: rows that they
exclude are not generated, and partitions without rows are not planned.  Names of
options are case-insensitive; a shape that has no matrix is an error when the
source is loaded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from rotaspark.functions.bits import MASK, drawn, units
from rotaspark.plans.pattern import Pattern
from rotaspark.sources.generated import BATCH_ENTRIES, SEED, TASK_ENTRIES, VECTOR_SEED, entries


@dataclass
class Rows(InputPartition):
    """Rows [first, last)."""

    first: int
    last: int


class RangeReader(DataSourceReader):
    """Rows of [0, n), less what the filters exclude."""

    key = "row"

    def __init__(self, n: int):
        self.low, self.high, self.only = 0, n, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != (self.key,):
                yield f
            elif isinstance(f, IsNotNull):
                continue
            elif isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self._only(set(f.value))
            elif not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._only({value})
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value + 1)
            else:
                yield f

    def _only(self, rows: set[int]) -> None:
        self.only = rows if self.only is None else self.only & rows

    def spans(self) -> list[tuple[int, int]]:
        """The ranges of rows that are wanted."""
        if self.only is None:
            return [(self.low, self.high)] if self.low < self.high else []
        spans: list[tuple[int, int]] = []
        for r in sorted(x for x in self.only if self.low <= x < self.high):
            if spans and spans[-1][1] == r:
                spans[-1] = (spans[-1][0], r + 1)
            else:
                spans.append((r, r + 1))
        return spans

    def cut(self, first: int, last: int) -> list[int]:
        """Where the partitions of a range begin, and its end."""
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        found = [self.cut(*span) for span in self.spans()]
        # A source without partitions gets one; this one has no rows.
        return [Rows(a, b) for edges in found for a, b in zip(edges, edges[1:]) if a < b] or [Rows(0, 0)]


class MatrixReader(RangeReader):
    def __init__(self, pattern: Pattern, seed: int, size: int):
        super().__init__(pattern.n)
        self.pattern, self.seed, self.size = pattern, seed, size

    def cut(self, first: int, last: int) -> list[int]:
        begin, end = int(self.pattern.row_ptr(first)), int(self.pattern.row_ptr(last))
        parts = max(1, -(-(end - begin) // self.size))
        inner = [min(last, max(first, self.pattern.first_row_with(begin + (end - begin) * t // parts))) for t in range(1, parts)]
        return [first, *inner, last]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.first < partition.last:
            for columns in entries(partition.first, partition.last, self.pattern, self.seed):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "pos", "col", "val"])


class VectorReader(RangeReader):
    key = "i"

    def __init__(self, n: int, seed: int, size: int):
        super().__init__(n)
        self.start, self.size = np.uint64((seed ^ VECTOR_SEED) & MASK), size

    def cut(self, first: int, last: int) -> list[int]:
        return [*range(first, last, self.size), last]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for low in range(partition.first, partition.last, BATCH_ENTRIES):
            i = np.arange(low, min(partition.last, low + BATCH_ENTRIES))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(units(drawn(self.start, i.astype(np.uint64) + np.uint64(1))))], ["i", "v"])


class _Generated(DataSource):
    def _number(self, name: str, otherwise: int | None = None) -> int:
        text = self.options.get(name)
        if text is None and otherwise is None:
            raise ValueError(f"{self.name()} needs the option {name}")
        try:
            return otherwise if text is None else int(text, 0)
        except ValueError:
            raise ValueError(f"{name} must be a whole number, not {text!r}") from None


class GeneratedMatrix(_Generated):
    @classmethod
    def name(cls) -> str:
        return "generated_matrix"

    def schema(self) -> str:
        self.reader(None)
        return "row long, pos long, col long, val double"

    def reader(self, schema) -> MatrixReader:
        pattern = Pattern(self._number("n"), self._number("nz"), self.options.get("mode", "irregular"))
        return MatrixReader(pattern, self._number("seed", SEED), max(1, self._number("entries", TASK_ENTRIES)))


class GeneratedVector(_Generated):
    @classmethod
    def name(cls) -> str:
        return "generated_vector"

    def schema(self) -> str:
        self.reader(None)
        return "i long, v double"

    def reader(self, schema) -> VectorReader:
        n = self._number("n")
        if n <= 0:
            raise ValueError("n must be positive")
        return VectorReader(n, self._number("seed", SEED), max(1, self._number("entries", TASK_ENTRIES)))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GeneratedMatrix, GeneratedVector):
        spark.dataSource.register(source)
