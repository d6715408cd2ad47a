"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of lines, a line's id the 128-bit hash of its bytes.
Blank lines have no id of their own: they go with the line after them.

Suffixes are ranked by their first 1, 2, 4, ... lines.  The rank of 2k lines is
the order of the pair (rank of k lines here, rank of k lines k lines further on).
A bucket ranks the suffixes whose first line's id is in its range, so ranks of all
buckets compare without being counted through.  A first line that is very common
has a place of its own in that order, and below it there is a bucket for each range
of following lines.  A class of equal
ranks with at least two suffixes is an interval of the suffix array whose longest
common prefix has at least so many lines; other suffixes are settled.  Doubling
ends when no interval is left.

Then the exact common prefix of every later copy with an earlier suffix is found
from the largest power of two down: copies that share a run of c lines form a
class, which is split by the rank of the next 2^k lines; all but the first of a
part are copies of c + 2^k lines and go on in a class of their own, with the first
as their partner, and the firsts of the parts stay.

Lines are kept in blocks of whole documents.  A block sends each distinct pair
once, with its first place, so a run in a third of all documents costs a bucket
one entry a block.  Blocks are written to the shared folder after each round.

In an interval the occurrence with the smallest (doc_id, line) is the original,
all others are later copies, and a line is deleted if it lies in a later copy of a
run of at least MIN_LINES lines.  A copy is maximal if the one that starts a line
before does not reach its end; n_runs counts stretches of deleted lines.

Null text is the empty text, a document of no lines.  Null ids come last.  Rows
that repeat an id come in the order of the hash of their text; rows that repeat
id and text count as one document and get the same result.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import discard, materialize, read, text_of

#: Shortest repeated run whose later copies are deleted: a single line that recurs is no run.
MIN_LINES = 2
#: A line is very common if it makes so large a part of its bucket's lines.
COMMON = 0.01
#: Bits of a rank below the bucket: common lines passed (odd: at one), range of the following line, place.
PASSED, FOLLOWING = np.uint64(40), np.uint64(24)
#: Bytes of text whose lines make a block (about), and blocks at most (ranks hold 16 bits of a bucket).
BLOCK_BYTES, BLOCKS = 12_000_000, 1 << 16
LAST = np.iinfo(np.int64).max
BLANK = " \t\r\x0b\x0c"

_ENTRY = np.dtype([("key", "<u8", 4), ("doc", "<i8"), ("tie", "<i8"), ("line", "<i4"), ("number", "<i4"), ("count", "<i4")])
_ANSWER = np.dtype([("rank", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("line", "<i4"), ("number", "<i4")])
MESSAGE = "to int, at int, data binary"
STATE = "block int, open long, data binary"


def _blank(line: str) -> bool:
    return not line.strip(BLANK)


def line_ids(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """block, doc_id, tie, ids: the hashes of a document's lines that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids = [b"".join([xxh3_128_digest(x.encode()) for x in text.split("\n") if x.strip(BLANK)]) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["block", "doc_id", "tie", "ids"])

    return _keyed(docs, id_col, text_col, blocks).mapInArrow(run, "block int, doc_id long, tie long, ids binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """block, doc_id, tie (the text's hash), text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "tie", "text")


class Lines:
    """A block's lines in the order of (doc_id, tie, line), and what is known of the runs that start at them."""

    def __init__(self, doc: np.ndarray, tie: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.doc, self.tie, self.sizes = doc, tie, sizes
        self.row = np.repeat(np.arange(len(doc)), sizes)
        self.line = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = sizes[self.row] - self.line  # lines to the document's end
        self.ids: np.ndarray | None = ids
        #: By level: rank of the run of 2**level lines (0: it occurs once), and where its first occurrence is.
        self.ranks: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.threads: dict[str, np.ndarray] | None = None

    def places(self, which: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), _ANSWER)
        row = self.row[which]
        out["doc"], out["tie"], out["line"], out["rank"], out["number"] = self.doc[row], self.tie[row], self.line[which], 0, 0
        return out

    def is_first(self, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        row = self.row[which]
        return (first["doc"] == self.doc[row]) & (first["tie"] == self.tie[row]) & (first["line"] == self.line[which])


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["tie"] == b["tie"]) & (a["line"] == b["line"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of keys its number among the distinct ones; of these, the first row and how many there are."""
    order = np.lexsort(keys.T[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new], np.diff(np.flatnonzero(new), append=len(order))


def pairs_up(b: Lines, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, keys and buckets for the next doubling."""
    top = np.uint64(48)
    if not b.ranks:
        at, a = np.arange(len(b.row)), b.ids
        high = (a[:, 0] >> top) * np.uint64(blocks) >> np.uint64(16) << top
        keys = np.stack([high, a[:, 0], a[:, 1], np.zeros(len(a), np.uint64)], 1)
    else:
        rank, k = b.ranks[-1], 1 << (len(b.ranks) - 1)
        at = np.flatnonzero((rank > 0) & (b.left > k))
        at = at[rank[at + k] > 0]
        one, two = rank[at], rank[at + k]
        high = one >> FOLLOWING << FOLLOWING
        if k == 1:
            common = (one >> PASSED & np.uint64(1)) > 0
            high = np.where(common, high | two >> top << FOLLOWING, high)
        keys = np.stack([high, one, two, np.zeros(len(at), np.uint64)], 1)
    high = keys[:, 0]
    mixed = (high >> top) * np.uint64(40503) + (high >> PASSED & np.uint64(255)) * np.uint64(977) + (high >> FOLLOWING & np.uint64(0xFFFF))
    return at, keys, (mixed % np.uint64(blocks)).astype(np.int64)


def pairs_down(level: int) -> Callable[[Lines, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Threads whose copies may go on for the run of 2**level lines after them."""

    def pairs(b: Lines, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = b.threads
        at = np.flatnonzero(b.left[t["at"]] > t["size"])
        following = b.ranks[level][t["at"][at] + t["size"][at]]
        at, following = at[following > 0], following[following > 0]
        mixed = (t["name"][at] * np.uint64(0x9E3779B97F4A7C15) + following) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
        to = mixed % np.uint64(blocks)
        keys = np.stack([to << np.uint64(48), t["size"][at].astype(np.uint64), t["name"][at], following], 1)
        return at, keys, to.astype(np.int64)

    return pairs


def _state(block: int, b: Lines, open_: int) -> pa.Table:
    data = pa.compress(raw := pickle.dumps(b), "zstd", asbytes=True)
    return pa.table([pa.array([block], pa.int32()), pa.array([open_], pa.int64()), pa.array([len(raw).to_bytes(8, "little") + data], pa.binary())], ["block", "open", "data"])


def _lines(data: bytes) -> Lines:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def _build(table: pa.Table) -> pa.Table:
    """A block's state; rows that repeat id and text count once."""
    found = {}
    for doc, tie, ids in zip(table["doc_id"].to_pylist(), table["tie"].to_pylist(), table["ids"].to_pylist()):
        found[LAST if doc is None else doc, tie] = ids
    keys = sorted(found)
    doc, tie = (np.array([k[j] for k in keys], np.int64) for j in (0, 1))
    ids = np.frombuffer(b"".join([found[k] for k in keys]), "<u8").reshape(-1, 2)
    b = Lines(doc, tie, np.array([len(found[k]) // 16 for k in keys], np.int64), ids)
    return _state(table["block"][0].as_py(), b, len(ids))


def _merge(table: pa.Table, lines: bool) -> pa.Table:
    """Keys of all blocks: those that occur again get their rank in the bucket's range and their first place; lines: keys are single lines."""
    at = np.repeat(table["at"].to_numpy(), [len(d) // _ENTRY.itemsize for d in table["data"].to_pylist()])
    e = np.frombuffer(b"".join(table["data"].to_pylist()), _ENTRY)
    k = e["key"]
    order = np.lexsort((e["line"], e["tie"], e["doc"], k[:, 3], k[:, 2], k[:, 1], k[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (k[order[1:]] != k[order[:-1]]).any(1)
    group = np.cumsum(new) - 1
    first = order[new]
    count = np.add.reduceat(e["count"][order].astype(np.int64), np.flatnonzero(new))
    again = count > 1
    # Ranks count on within the range that the key's first part names.
    high = k[first, 0]
    if lines:
        common = again & (count > COMMON * count.sum())  # less than 1 / COMMON of them
        high = high | (2 * np.cumsum(common) - common).astype(np.uint64) << PASSED
    begins = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
    inside = np.arange(len(first)) - np.repeat(begins, np.diff(begins, append=len(first)))
    rank = high | (inside + 1).astype(np.uint64)
    which = np.flatnonzero(again[group])
    out = np.empty(len(which), _ANSWER)
    g, o = group[which], order[which]
    out["rank"], out["number"] = rank[g], e["number"][o]
    for c in ("doc", "tie", "line"):
        out[c] = e[c][first[g]]
    to = at[o]
    by = np.argsort(to, kind="stable")
    keys, begins = np.unique(to[by], return_index=True)
    rows = [(int(b), out[w].tobytes()) for b, w in zip(keys, np.split(by, begins[1:]))] if len(by) else []
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["to", "at", "data"])


def _raised(b: Lines, at: np.ndarray, rank: np.ndarray, first: np.ndarray) -> int:
    """Add a level of ranks."""
    ranks = np.zeros(len(b.row), np.uint64)
    ranks[at] = rank
    firsts = np.zeros(len(b.row), _ANSWER)
    firsts[at] = first
    b.ranks.append(ranks)
    b.firsts.append(firsts)
    b.ids = None
    return int((rank > 0).sum())


def _begun(b: Lines, level: int) -> dict[str, np.ndarray]:
    """Threads of the runs of 2**level lines, but for copies of twice as many."""
    rank, first = b.ranks[level], b.firsts[level]
    at = np.flatnonzero(rank > 0)
    if level + 1 < len(b.ranks):
        longer = b.ranks[level + 1][at] > 0
        longer[longer] = ~b.is_first(at[longer], b.firsts[level + 1][at[longer]])
        at = at[~longer]
    return {"at": at, "name": rank[at], "size": np.full(len(at), 1 << level), "copy": ~b.is_first(at, first[at]), "source": first[at]}


def _extended(b: Lines, at: np.ndarray, rank: np.ndarray, first: np.ndarray, level: int) -> int:
    """Threads after the test of 2**level more lines: later ones go on, the first stays and leaves a partner."""
    t = b.threads
    again = np.flatnonzero(rank > 0)
    at, rank, first = at[again], rank[again], first[again]
    is_first = b.is_first(t["at"][at], first)
    moves = at[~is_first]
    go = {"at": t["at"][at], "name": rank, "size": t["size"][at] + (1 << level), "copy": ~is_first, "source": first}
    stay = np.ones(len(t["at"]), bool)
    stay[moves] = False
    parts = [{k: v[stay] for k, v in t.items()}, go]
    if level:  # single lines are extended no further
        parts.append(_begun(b, level))
    b.threads = {k: np.concatenate([p[k] for p in parts]) for k in t}
    return len(b.threads["at"])


def _round(state: DataFrame, name: str, blocks: int, pairs: Callable, update: Callable[[Lines, np.ndarray, np.ndarray, np.ndarray], int], lines: bool = False) -> DataFrame:
    """One exchange: blocks send their distinct keys to buckets and take back the ranks of those that occur again."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = _lines(data)
                at, keys, to = pairs(b, blocks)
                if not len(at):
                    continue
                _, first, count = _distinct(keys)
                # The lines stand in order, so the first row of a key is its first place here.
                where = b.places(at[first] if b.threads is None else b.threads["at"][at[first]])
                e = np.empty(len(first), _ENTRY)
                e["key"], e["number"], e["count"] = keys[first], np.arange(len(first)), count
                for c in ("doc", "tie", "line"):
                    e[c] = where[c]
                order = np.argsort(to[first], kind="stable")
                found, begins = np.unique(to[first][order], return_index=True)
                parts = [e[w].tobytes() for w in np.split(order, begins[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int32()), pa.array(parts, pa.binary())], ["to", "at", "data"])

    def take(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _EMPTY
        block, b = left["block"][0].as_py(), _lines(left["data"][0].as_py())
        at, keys, _ = pairs(b, blocks)
        number, first, _ = _distinct(keys)
        rank, place = np.zeros(len(first), np.uint64), np.zeros(len(first), _ANSWER)
        a = np.frombuffer(b"".join(answers["data"].to_pylist()), _ANSWER)
        rank[a["number"]], place[a["number"]] = a["rank"], a
        return _state(block, b, update(b, at, rank[number], place[number]))

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, lines)

    sent = state.select("block", "data").mapInArrow(send, MESSAGE).groupBy("to").applyInArrow(merge, MESSAGE)
    following = materialize(state.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(take, STATE), name)
    discard(state)
    return following


_EMPTY = pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["block", "open", "data"])


def _map(state: DataFrame, name: str, change: Callable[[Lines], None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                b = _lines(data)
                change(b)
                yield from _state(block, b, 0).to_batches()

    following = materialize(state.mapInArrow(run, STATE), name)
    discard(state)
    return following


def copied_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, tie, line, size, id, from: arrays of a document's runs that are later copies, of min_lines and more, and their first occurrences.

    The longest from each line; a line may have shorter ones as well.
    """
    size = docs.select(F.octet_length(text_of(text_col)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, min(BLOCKS, -(-int(size) // BLOCK_BYTES)))
    state = materialize(line_ids(docs, id_col, text_col, blocks).groupBy("block").applyInArrow(_build, STATE), "lines-0")
    levels = 0
    while True:
        state = _round(state, f"lines-{1 << levels}", blocks, pairs_up, _raised, levels == 0)
        if not state.agg(F.sum("open")).first()[0]:
            break
        levels += 1
    if levels > 1:
        top = levels - 1

        def begin(b: Lines) -> None:
            b.threads = _begun(b, top)

        state = _map(state, "copies", begin)
        for level in range(top - 1, -1, -1):
            state = _round(state, f"copies-{1 << level}", blocks, pairs_down(level), lambda b, at, rank, first, level=level: _extended(b, at, rank, first, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                b = _lines(data)
                at = np.flatnonzero(b.ranks[0] > 0) if min_lines <= 1 else np.empty(0, np.int64)
                at = at[~b.is_first(at, b.firsts[0][at])]
                found = [(at, np.ones(len(at), np.int64), b.firsts[0][at])]
                if b.threads is not None:
                    w = np.flatnonzero(b.threads["copy"] & (b.threads["size"] >= min_lines))
                    found.append((b.threads["at"][w], b.threads["size"][w], b.threads["source"][w]))
                at, size, source = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((size, at))
                last = np.append(at[order[1:]] != at[order[:-1]], True) if len(order) else np.empty(0, bool)
                order = order[last]  # the longest from each line
                at, size, source = at[order], size[order], source[order]
                row = b.row[at]
                docs_, begins = np.unique(row, return_index=True)
                ends = np.append(begins[1:], len(row)).astype(np.int32)
                edges = pa.array(np.append(begins, len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, t, mask=m)) for x, t, m in ((b.line[at], pa.int64(), None), (size, pa.int64(), None), (source["doc"], pa.int64(), source["doc"] == LAST), (source["line"].astype(np.int64), pa.int64(), None))]
                ids = pa.array(b.doc[docs_], pa.int64(), mask=b.doc[docs_] == LAST)
                if len(docs_) and len(ends):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(b.tie[docs_]), *lists], ["doc_id", "tie", "line", "size", "id", "from"])

    return state.select("data").mapInArrow(run, "doc_id long, tie long, line array<long>, size array<long>, id array<long>, from array<long>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed (lines, without blank ones), n_runs (stretches of them), longest_copy, copies, kept_sha256; with keep_text also kept.

    longest_copy: lines of the longest run that is a later copy.
    copies: the maximal ones, with the first occurrence of each; lines are numbered from 0, without blank ones.
    """
    runs = copied_runs(docs, id_col, text_col, min_lines).withColumnRenamed("doc_id", "__id")
    texts = _keyed(docs, id_col, text_col, 1)
    joined = texts.join(runs, F.col("doc_id").eqNullSafe(F.col("__id")) & (texts["tie"] == runs["tie"]), "left").select("doc_id", "text", "line", "size", "id", "from")
    schema = "doc_id long, n_lines long, n_removed long, n_runs long, longest_copy long, copies array<struct<line:long,size:long,source_id:long,source_line:long>>, kept_sha256 string" + (", kept string" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cut(*row) for row in zip(*[c.to_pylist() for c in batch.columns])]
            columns = list(zip(*rows)) if rows else [()] * 8
            long = pa.int64()
            copies = pa.list_(pa.struct([(x, long) for x in ("line", "size", "source_id", "source_line")]))
            kinds = (long, long, long, long, long, copies, pa.string(), pa.string())
            names = ["doc_id", "n_lines", "n_removed", "n_runs", "longest_copy", "copies", "kept_sha256", "kept"]
            k = 8 if keep_text else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:k], kinds)], names[:k])

    return joined.mapInArrow(run, schema)


def _cut(doc_id: int | None, text: str, at: list[int] | None, size: list[int] | None, ids: list[int | None] | None, lines_from: list[int] | None) -> tuple:
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if not _blank(x)]
    if not at:
        return doc_id, len(full), 0, 0, 0, [], hashlib.sha256(text.encode()).hexdigest(), text
    longest = dict(zip(at, size))
    copies = [
        {"line": p, "size": n, "source_id": i, "source_line": q}
        for p, n, i, q in zip(at, size, ids, lines_from)
        if longest.get(p - 1) != n + 1
    ]
    edge = np.zeros(len(full) + 1, np.int64)
    np.add.at(edge, np.array(at), 1)
    np.add.at(edge, np.array(at) + np.array(size), -1)
    gone = np.cumsum(edge[:-1]) > 0
    keep = np.ones(len(lines), bool)
    for k in np.flatnonzero(gone):  # with the blank lines before it
        keep[full[k - 1] + 1 if k else 0 : full[k] + 1] = False
    kept = "\n".join([x for x, k in zip(lines, keep) if k])
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return doc_id, len(full), int(gone.sum()), runs, max(size), copies, hashlib.sha256(kept.encode()).hexdigest(), kept


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_copy", "kept_sha256")


#: Classes are named by the place of their first run; the recursion makes runs a line longer at a time.
OP6_SQL = f"""
WITH RECURSIVE every AS MATERIALIZED (
  SELECT doc_id, i, x, length(trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) = 0 AS blank
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
lines AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line, x, i FROM every WHERE NOT blank),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS place, min(doc_id * 1000000 + line) OVER (PARTITION BY x) AS id FROM lines),
runs AS (
  SELECT doc_id, line, place, first, k FROM (SELECT doc_id, line, place, 1 AS k, min(place) OVER (PARTITION BY x) AS first, count(*) OVER (PARTITION BY x) AS c FROM placed) WHERE c > 1
  UNION ALL
  SELECT doc_id, line, place, first, k FROM (
    SELECT r.doc_id, r.line, r.place, r.k + 1 AS k, min(r.place) OVER (PARTITION BY r.first, p.id) AS first, count(*) OVER (PARTITION BY r.first, p.id) AS c
    FROM runs r JOIN placed p ON p.doc_id = r.doc_id AND p.line = r.line + r.k) WHERE c > 1),
copies AS MATERIALIZED (SELECT doc_id, line, k FROM runs WHERE place <> first AND k >= {MIN_LINES}),
gone AS (SELECT DISTINCT doc_id, line + d AS line FROM copies, unnest(range({MIN_LINES})) AS u(d) WHERE k = {MIN_LINES}),
marked AS (SELECT l.doc_id, l.line, l.i, g.line IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, line)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS begins, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY line), 0) AS before FROM marked),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs FROM edges GROUP BY 1),
dropped AS (SELECT doc_id, unnest(range(before + 1, i + 1)) AS i FROM edges WHERE gone),
kept AS (SELECT e.doc_id, string_agg(e.x, chr(10) ORDER BY e.i) AS t FROM every e ANTI JOIN dropped d USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce((SELECT max(k) FROM copies c WHERE c.doc_id = d.doc_id), 0)::BIGINT AS longest_copy, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
