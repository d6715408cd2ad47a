"""Best-fit packing of token sequences, bulk-synchronously.

Documents and gaps are sorted by size.  A round takes all documents of one
length, from the longest down, finds for them the smallest gaps that hold them
(the successors of the length in gap order), settles who gets which gap by the
documents' rank within their length, updates the gaps and goes on.  A length
is an integer of at most the capacity, so rows of one length are
interchangeable: a round works on runs of sequences that have the same
contents, the sweep needs the histogram of lengths only (`capacity` numbers,
whatever the input), and the rows themselves meet the outcome through their
rank, which is counted in parallel over salted groups.

Null text is the empty text: a document of one token.  Repeated ids are
separate documents.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.bpe import TOGETHER, encoder, vocabulary_path
from rotaspark.llm.common import materialize, read, salt, shuffle_partitions, text_of

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Rows of the plan, which depends on the lengths' histogram and never on the number of rows.
PLAN_LIMIT = 4_000_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut at the capacity."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), TOGETHER):
                enc.forget()
                for doc_id, words in zip(ids_of[first : first + TOGETHER], enc.prepare(texts[first : first + TOGETHER])):
                    ids = enc.joined(words) + END
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.clear()  # the worker lives on

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, documents a sequence, offset) per segment.

    A run is [first sequence, sequences]; runs[g] holds the runs whose gap is g,
    sizes the gaps that there are, sorted.
    """
    runs: dict[int, list[list[int]]] = {}
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def add(gap: int, run: list[int]) -> None:
        if gap:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(sizes, gap)
            runs[gap].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, n = run = runs[gap].pop()
            each = gap // length  # what is left of a best fit is the best fit of the next document
            used = min(n, -(-left // each))
            full = min(used, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - gap))
                add(gap - each * length, [first, full])
                rank, left = rank + full * each, left - full * each
            if used > full:
                plan.append((length, rank, left, first + full, left, capacity - gap))
                add(gap - left * length, [first + full, 1])
                rank, left = rank + left, 0
            if n > used:
                run[:] = [first + used, n - used]
                runs[gap].append(run)
            if not runs[gap]:
                del runs[gap]
                sizes.remove(gap)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                plan.append((length, rank, full * each, sequences, each, 0))
                add(capacity - each * length, [sequences, full])
                rank, sequences = rank + full * each, sequences + full
            if rest:
                plan.append((length, rank, rest, sequences, rest, 0))
                add(capacity - rest * length, [sequences, 1])
                sequences += 1
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with an integer column length of 1 to capacity) and their sequence_id and offset.

    pieces is read twice: give a materialized one.
    """
    spark = pieces.sparkSession
    n = shuffle_partitions(spark)
    order = [c for c in ("doc_id", "piece") if c in pieces.columns]
    salted = pieces.withColumn("__salt", salt(n, *order))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    # At most `capacity` rows: lengths are integers from 1 to capacity.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("every piece must have between 1 and capacity tokens")
    plan = best_fit_plan(histogram, capacity)
    if len(plan) > PLAN_LIMIT:
        raise ValueError(f"the plan has {len(plan)} segments")
    table = np.array(plan, np.int64).reshape(-1, 6)
    where = spark.sparkContext.broadcast({int(k): table[table[:, 0] == k][:, 1:] for k in np.unique(table[:, 0])})

    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.withColumn("__place", F.row_number().over(within) - 1).join(offsets, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__place") + F.col("__before")).alias("__rank"))
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            length = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, segments = np.flatnonzero(length == k), where.value[int(k)]
                s = segments[np.searchsorted(segments[:, 0], rank[at], "right") - 1]
                inside = rank[at] - s[:, 0]
                sequence[at] = s[:, 2] + inside // s[:, 3]
                offset[at] = s[:, 4] + inside % s[:, 3] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(token_pieces(docs, capacity), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
