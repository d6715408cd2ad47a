"""Ranked lexical search: sums of the short lists, then documents in turn with skipping over the long ones.

The texts are cut into terms once.  Each task turns runs of documents into
shards: posting lists of the terms that some query has, written as one row a
shard.  Counts of documents, terms and documents a term are sums over shards.
A second pass reads the shards where they lie and answers all queries on each:

* lists that hold few of the shard's documents are summed, a term at a time;
* their sums are one more list with a known largest value, which is met with the
  long lists document by document, a block of documents at a time.  Lists whose
  largest values cannot reach the last place of the answer so far are essential
  to no document, and are only looked up for documents that still can.

A task carries its best documents on from shard to shard, so the bar rises; tasks'
answers are merged in two rounds of ranks.  Results are exact.

Queries are dealt into blocks whose terms fit a task's memory; each block reads
all documents.  Null texts hold no term.  Ids may be null or repeat: each row is a
document (null ids last among equal scores), and each distinct row a query.
Texts of any length are read whole, a piece at a time.  Empty tables give an
empty result, and other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import materialize, read

#: Best documents of a query.
TOP = 50
#: Bytes of text after which a shard is closed, and bytes of queries in a block.
SHARD_BYTES, QUERY_BYTES = 16 << 20, 32 << 20
#: A list is short if it holds at most one in so many of the shard's documents.
SHORT = 16
#: Documents of a block in the pass over long lists.
BLOCK = 2048
#: Bytes of a text cut into terms at once.
PIECE = 4 << 20
#: Salts of the first round of merging.
SALTS = 32
#: Fixed values of the score.
SCALE, LENGTH_SHARE = 1_000_000_000, 50
#: ASCII letters and digits and all bytes of other characters make terms; letters become small, all else a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands for a null id in the arrays of a shard.
NO_ID = np.iinfo(np.int64).max

SHARD = "docs long, words long, terms array<int>, lengths array<int>, at binary, tf binary, ids binary, nulls binary, sizes binary"


def terms(text: bytes, piece: int = PIECE) -> Counter:
    """Terms with how often they occur."""
    found: Counter = Counter()
    clean, at = text.translate(TABLE), 0
    while len(clean) - at > piece:
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        found.update(clean[at:end].split())
        at = end
    found.update(clean[at:].split())
    return found


class Shard:
    """Documents of one task, gathered into posting lists."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers, self.docs, self.words, self.bytes = numbers, 0, 0, 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.postings: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms(text)
        self.bytes += len(text)
        if not found:
            return
        n = found.total()
        self.docs += 1
        self.words += n
        here = [(self.numbers[t], len(self.ids), k) for t, k in found.items() if t in self.numbers]
        if here:
            self.ids.append(doc_id)
            self.sizes.append(n)
            self.postings += here

    def record(self) -> pa.RecordBatch:
        term, at, tf = np.array(self.postings, np.int64).reshape(-1, 3).T
        order = np.lexsort((at, term))
        names, lengths = np.unique(term, return_counts=True)
        nulls = np.array([x is None for x in self.ids], bool)
        ids = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (names, lengths)]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (at[order].astype(np.int32), tf[order].astype(np.int32), ids, nulls, np.array(self.sizes, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([self.docs]), pa.array([self.words]), *lists, *blobs], [c.split()[0] for c in SHARD.split(", ")])


def index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of docs for the numbered terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(numbers)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py() or b"")
                if shard.bytes >= SHARD_BYTES:
                    yield shard.record()
                    shard = Shard(numbers)
        yield shard.record()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(build, SHARD)


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top, self.score, self.ids, self.nulls = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def bar(self) -> int:
        """A document needs as high a score at least."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        score, ids, nulls = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((nulls, ids, -score))[: self.top]
        self.score, self.ids, self.nulls = score[order], ids[order], nulls[order]


def search(lists: list[tuple[np.ndarray, np.ndarray]], n: int, ids: np.ndarray, nulls: np.ndarray, best: Best, short: int = SHORT, block: int = BLOCK) -> None:
    """Adds a shard's best documents; lists are (ascending places below n, positive values)."""
    few = [x for x in lists if len(x[0]) * short <= n]
    met = [x for x in lists if len(x[0]) * short > n]
    if few:  # term at a time
        places, at = np.unique(np.concatenate([d for d, _ in few]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, at, np.concatenate([v for _, v in few]))
        met.append((places, sums))
    met.sort(key=lambda x: x[1].max())
    reach = np.cumsum([int(v.max()) for _, v in met])  # what the lists up to one can give together
    for first in range(0, n, block):  # document at a time
        bar, last = best.bar, min(n, first + block)
        idle = int(np.searchsorted(reach, bar))  # these lists alone do not reach the bar
        if idle == len(met):
            return
        total = np.zeros(last - first, np.int64)
        for d, v in met[idle:]:
            a, b = np.searchsorted(d, (first, last))
            total[d[a:b] - first] += v[a:b]
        here = np.flatnonzero(total)
        score = total[here]
        for k in range(idle - 1, -1, -1):
            able = score + reach[k] >= bar
            here, score = here[able], score[able]
            if not len(here):
                break
            d, v = met[k]
            at = np.minimum(np.searchsorted(d, here + first), len(d) - 1)
            score = score + np.where(d[at] == here + first, v[at], 0)
        able = score >= bar
        if able.any():
            best.add(score[able], ids[here[able] + first], nulls[here[able] + first])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Distinct (item_id, text) with a block number, and the number of blocks."""
    some = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    return some.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))).cast("int")), blocks


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """query, doc_id, score to the best of each query with their rank, in two rounds."""
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "query"), F.lit(SALTS)))
    first = salted.withColumn("rank", best("query", "salt")).filter(F.col("rank") <= top)
    return first.withColumn("rank", best("query")).filter(F.col("rank") <= top)


def _searched(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of queries, which the driver holds (QUERY_BYTES)."""
    spark = docs.sparkSession
    queries = [(r.item_id, [*terms(r.text.encode())]) for r in block.collect()]
    numbers: dict[bytes, int] = {}
    wanted = [np.array([numbers.setdefault(t, len(numbers)) for t in found], np.int64) for _, found in queries]
    shards = materialize(index(docs, numbers), "lexical")
    n_docs, n_words = shards.agg(F.sum("docs"), F.sum("words")).first()
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = np.zeros(len(numbers), np.int64)
    each = shards.select(F.inline(F.arrays_zip("terms", "lengths"))).groupBy("terms").agg(F.sum("lengths").alias("df"))  # as many rows as the block has terms
    for term, df in each.collect():
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in wanted]
        for batch in batches:
            for shard in batch.to_pylist():
                of = np.full(len(numbers), -1)
                names, lengths = np.array(shard["terms"], np.int64), np.array(shard["lengths"], np.int64)
                of[names] = np.arange(len(names))
                at, tf = (np.frombuffer(shard[c], np.int32).astype(np.int64) for c in ("at", "tf"))
                ids, sizes, nulls = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["sizes"], np.int64), np.frombuffer(shard["nulls"], bool)
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // n_words
                value = np.repeat(weight[names], lengths) * ((SCALE * tf) // (1000 * tf + 20 * m[at]))
                ends = np.cumsum(lengths)
                lists = [(at[e - k : e], value[e - k : e]) if w else None for e, k, w in zip(ends.tolist(), lengths.tolist(), weight[names].tolist())]
                for terms_, found in zip(wanted, best):
                    here = [lists[k] for k in of[terms_].tolist() if k >= 0 and lists[k] is not None]
                    if here:
                        search(here, len(ids), ids, nulls, found)
        sizes = [len(x.score) for x in best]
        if sum(sizes):
            score, ids, nulls = (np.concatenate([getattr(x, c) for x in best]) for c in ("score", "ids", "nulls"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(ids, mask=nulls), pa.array(score)], ["query", "doc_id", "score"])

    best = _ranked(shards.mapInArrow(answer, "query int, doc_id long, score long"), top)
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(queries)], "query int, item_id long")
    return best.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every query."""
    some, blocks = _blocks(items, item_col, text_col)
    found = [_searched(docs, some.filter(F.col("block") == k), top) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '{_TERM}') AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM s),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM s) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
i AS (SELECT k, item_id, unnest(list_distinct(regexp_extract_all({_SMALL}, '{_TERM}'))) AS t FROM (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT item_id, text FROM benchmark))),
q AS (SELECT k, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t) JOIN s USING (r), c GROUP BY k, item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM q JOIN s USING (r) WHERE score > 0)
SELECT * FROM o WHERE rank <= {TOP}
"""
