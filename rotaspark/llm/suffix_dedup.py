"""Suffix-array dedup: removes later copies of byte strings of at least LENGTH bytes.

A position's longest previous factor is the longest match of its suffix with a
suffix of an earlier document.  In suffix order the candidates are the previous
and the next position with a smaller document id, and a byte goes if it lies in
a string of LENGTH bytes whose factor reaches LENGTH.

Ordering all suffixes would move fifty bytes for each byte of text, so positions
without a previous factor are left out first:

1. anchors: of the GRAM-byte strings inside a LENGTH-byte string the one with
   the smallest hash; equal strings have equal anchors.  Positions whose anchor
   occurs in one document only have no previous factor and go no further.
2. stretches: neighbouring positions with one anchor (about fourteen) go as one
   byte string to their anchor's bucket; a block sends each stretch once, with
   its smallest id (later documents of the block are settled by comparing bytes).
3. suffixes: equal stretches of a bucket are one kind.  The suffixes of anchors
   that have several kinds (where copies begin and end) are sorted by their bytes,
   and previous and next smaller ids in that order give the factors.

Hashes choose what is compared; what is removed is decided by bytes.  Texts are
dealt once, into a bucketed table of blocks that all passes read in place, so a
passage in a third of all documents costs a bucket one entry a block and kind.

Null text is the empty text.  Matches never cross documents and never come from
the same doc_id (rows that repeat an id do not remove each other's bytes; null
ids count as larger than any id and as equal).  A document of any length is
hashed SLICE bytes at a time.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import delete, materialize, read, scratch_path, shuffle_partitions, text_of

LENGTH = 50
GRAM = 24
#: Positions of a stretch at most: one bit each.
STRETCH = 32
#: Bytes of text hashed at a time, and bytes of text in a block (about).
SLICE, BLOCK_BYTES = 1 << 20, 12_000_000
#: Stretches of a bucket compared at a time, at least all of one anchor.
TOGETHER = 150_000
LAST = np.iinfo(np.int64).max

_TABLE = np.random.default_rng(977).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


class Stretches(NamedTuple):
    """Parallel arrays, in text order: row of the document, first position, positions, anchor, hash of the bytes."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    name: np.ndarray

    def of(self, which: np.ndarray) -> Stretches:
        return Stretches(*[c[which] for c in self])


def _hash_slice(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> Stretches:
    """Stretches of pieces (row, offset in the document, bytes)."""
    raw = np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    begins = ends - [len(p[2]) for p in pieces]
    levels = [_TABLE[raw]]  # levels[k]: hash of the 2**k bytes from each position
    span = 1
    while 2 * span <= max(gram, length):
        h = levels[-1]
        levels.append(h[: len(h) - span] * _power(span) + h[span:] if len(h) > span else h[:0])
        span *= 2

    def over(n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of n bytes from the positions at (from all where it fits)."""
        out, done = None, 0
        for k in [k for k in range(len(levels) - 1, -1, -1) if n >> k & 1]:
            part = levels[k][done : done + len(raw) - n + 1] if at is None else levels[k][at + done]
            done += 1 << k
            out = part if out is None else out * _power(1 << k) + part
        return out

    reach = length - gram + 1
    least = _mixed(over(gram))
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if reach > span:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    # least[i]: anchor of the string of `length` bytes at i; those that leave their piece don't count.
    sizes = np.maximum(ends - begins - length + 1, 0)
    some = np.flatnonzero(sizes)
    offset = np.cumsum(sizes[some]) - sizes[some]
    at = np.arange(sizes.sum()) + np.repeat(begins[some] - offset, sizes[some])
    anchor = least[at]
    new = np.empty(len(at), bool)
    new[:1] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[offset] = True
    heads = np.flatnonzero(new)
    counts = np.diff(heads, append=len(at))
    if len(counts) and counts.max() > STRETCH:  # periodic text: an anchor that goes on and on
        inside = np.arange(len(at)) - np.repeat(heads, counts)
        heads = np.flatnonzero(inside % STRETCH == 0)
        counts = np.diff(heads, append=len(at))
    p = at[heads]
    name = _mixed(over(length, p) * np.uint64(0xC2B2AE3D27D4EB4F) + over(length, p + counts - 1) + counts.astype(np.uint64))
    piece = some[np.searchsorted(offset, heads, "right") - 1]
    row, from_ = (np.array([x[k] for x in pieces], np.int64) for k in (0, 1))
    return Stretches(row[piece].astype(np.int32), (p - begins[piece] + from_[piece]).astype(np.int64), counts.astype(np.uint8), anchor[heads], name)


def stretches_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Stretches:
    """Long texts are cut in pieces that overlap by length - 1 bytes, so no position is lost or met twice."""
    found: list[Stretches] = []
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for row, text in enumerate(texts):
        for off in range(0, max(1, len(text) - length + 1), SLICE):
            piece = text[off : off + SLICE + length - 1] if len(text) > SLICE else text
            if held and total + len(piece) > SLICE:
                found.append(_hash_slice(held, length, gram))
                held, total = [], 0
            if len(piece) >= length:
                held.append((row, off, piece))
                total += len(piece)
    if held:
        found.append(_hash_slice(held, length, gram))
    if not found:
        none = np.empty(0, np.uint64)
        return Stretches(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint8), none, none)
    return Stretches(*[np.concatenate(x) for x in zip(*found)])


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, or a last one of bytes, under compression."""
    body = b"".join(a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences as 32-bit numbers, byte plane by byte plane."""
    return np.ascontiguousarray(np.diff(a, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _summed(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel().astype(np.int64))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    keys, begins = np.unique(bucket[order], return_index=True)
    for key, at in zip(keys, np.split(order, begins[1:])):
        yield int(key), at


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
MESSAGE = "to int, at int, kind int, data binary"
#: Kinds of messages: anchors; stretches; a block's note to itself; positions with a previous factor.
ANCHORS, STRETCHES, NOTE, FACTORS = range(4)


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["to", "at", "kind", "data"])


def _of_kind(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """Sender and data."""
    return [(at, d) for at, k, d in zip(table["at"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()) if k == kind]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([LAST if i is None else i for i in column.to_pylist()], np.int64)


def _bytes_at(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The strings of these sizes one after the other."""
    ends = np.cumsum(sizes)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)]


def _table_of(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The strings as rows, filled up with zeros."""
    place = np.arange(width)
    rows = raw[np.minimum(begins[:, None] + place, len(raw) - 1)]
    rows[place >= sizes[:, None]] = 0
    return rows


def grouped(raw: np.ndarray, begins: np.ndarray, s: Stretches, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch its group of equal ones, and of each group the stretch with the smallest id; begins: in raw."""
    order = np.lexsort((ids[s.doc], s.size, s.name, s.anchor))
    new = np.ones(len(order), bool)
    new[1:] = (s.anchor[order[1:]] != s.anchor[order[:-1]]) | (s.name[order[1:]] != s.name[order[:-1]]) | (s.size[order[1:]] != s.size[order[:-1]])
    number = np.cumsum(new) - 1
    first = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = number
    # Equal hashes stand for equal bytes only where the bytes are equal.
    others = np.flatnonzero(first[group] != np.arange(len(group)))
    apart = []
    for at in range(0, len(others), 20_000):
        mine = others[at : at + 20_000]
        sizes = s.size[mine].astype(np.int64) + length - 1
        width = int(sizes.max())
        differ = (_table_of(raw, begins[mine], sizes, width) != _table_of(raw, begins[first[group[mine]]], sizes, width)).any(1)
        apart.append(mine[differ])
    if apart and (odd := np.concatenate(apart)).size:
        group[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return group, first


def previous_smaller(ids: np.ndarray, agrees: np.ndarray) -> np.ndarray:
    """Of each place in suffix order, the nearest one before it with a smaller id; -1 if there is none.

    agrees[i]: suffix i has the first bytes of suffix i - 1; the search ends where it is false.
    """
    at = np.where(agrees, np.arange(len(ids)) - 1, -1)
    while True:
        open_ = np.flatnonzero((at >= 0) & (ids[np.maximum(at, 0)] >= ids))
        if not len(open_):
            return at
        at[open_] = at[at[open_]]


def has_factor(suffixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For suffixes (rows of bytes), whether one with a smaller id has the same bytes."""
    keys = np.ascontiguousarray(suffixes).view(f"S{suffixes.shape[1]}").ravel()  # of one length, so zeros at the end don't matter
    order = np.argsort(keys, kind="stable")
    agrees = np.append(False, keys[order[1:]] == keys[order[:-1]]) if len(order) else np.empty(0, bool)
    sorted_ids = ids[order]
    before = previous_smaller(sorted_ids, agrees) >= 0
    after = previous_smaller(sorted_ids[::-1], np.append(False, agrees[:0:-1]) if len(order) else agrees)[::-1] >= 0
    out = np.empty(len(order), bool)
    out[order] = before | after
    return out


def _full(size: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def factors_of(anchor: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """For stretches of whole anchors, a bit for each position with a previous factor of `length` bytes."""
    sizes = size.astype(np.int64) + length - 1
    rows = np.concatenate([size[:, None], _table_of(raw, begins, sizes, int(sizes.max()))], 1)
    keys = rows.view(f"S{rows.shape[1]}").ravel()  # the size comes first, so zeros at the end don't matter
    order = np.lexsort((ids, keys, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]  # of each kind, the one with the smallest id
    bits = np.zeros(len(first), np.uint32)
    _, which, count = np.unique(anchor[first], return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[which] > 1)
    if len(several):
        windows = np.lib.stride_tricks.sliding_window_view(rows[first[several], 1:], length, 1)
        row, place = np.nonzero(np.arange(windows.shape[1]) < size[first[several], None])
        found = has_factor(windows[row, place], ids[first[several]][row])
        np.bitwise_or.at(bits, several[row[found]], np.uint32(1) << place[found].astype(np.uint32))
    return np.where(ids > ids[first[kind]], _full(size), bits[kind])


def blocks_table(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[str, str, int]:
    """A bucketed table (block, doc_id, data) in the shared folder; its buckets are read in place by every pass.

    Its name, its path and the number of blocks.
    """
    spark = docs.sparkSession
    carried = F.struct(*[F.col(c) for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("__null")) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "utf-8").alias("data"), carried.alias("carried"))
    size = docs.select(F.octet_length(text_of(text_col)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(shuffle_partitions(spark), -(-int(size) // BLOCK_BYTES))
    # Copies go to blocks of their own: the id alone decides, with the text's hash for rows that repeat an id.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("data")), F.lit(n)).cast("int"))
    name, path = f"suffix_blocks_{uuid.uuid4().hex}", scratch_path(spark, "suffix-blocks")
    rows.repartition(n, "block").write.option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(name)
    return name, path, n


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept (text, without characters cut in two) and carried (the other columns)."""
    spark = docs.sparkSession
    name, path, n = blocks_table(docs, id_col, text_col, keep_text)
    blocks = spark.table(name)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """31 bits of each anchor of a part of a block, and one whether two documents of the part have it."""
        for batch in batches:
            where = batch.column(0).to_numpy(zero_copy_only=False)
            for at in np.unique(where):
                part = batch.take(pa.array(np.flatnonzero(where == at)))
                s = stretches_of(part.column(2).to_pylist(), length, gram)
                if not len(s.doc):
                    continue
                ids = _ids(part.column(1))[s.doc]
                order = np.argsort(s.anchor, kind="stable")
                anchor, begin = np.unique(s.anchor[order], return_index=True)
                several = np.minimum.reduceat(ids[order], begin) != np.maximum.reduceat(ids[order], begin)
                short = (anchor >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | several
                rows = [(to, int(at), ANCHORS, short[w].astype(np.uint32).tobytes()) for to, w in _by_bucket((anchor % np.uint64(n)).astype(np.int64))]
                yield from _messages(rows).to_batches()

    def repeated(table: pa.Table) -> pa.Table:
        """To each block, which of its anchors another document has as well."""
        to = table["to"][0].as_py()
        sent: dict[int, list[np.ndarray]] = {}
        for at, data in zip(table["at"].to_pylist(), table["data"].to_pylist()):
            sent.setdefault(at, []).append(np.frombuffer(data, np.uint32))
        every = np.concatenate([d for parts in sent.values() for d in parts])
        key = every & np.uint32(0xFFFFFFFE)
        found, count = np.unique(key, return_counts=True)
        many = np.union1d(found[count > 1], key[(every & np.uint32(1)) == 1])
        rows = []
        for block, parts in sent.items():
            mine = np.unique(np.concatenate(parts) & np.uint32(0xFFFFFFFE))
            mine = mine[np.isin(mine, many, assume_unique=True)]
            if len(mine):
                rows.append((block, to, ANCHORS, mine.tobytes()))
        return _messages(rows)

    def stretches(left: pa.Table, answers: pa.Table) -> pa.Table:
        """The block's stretches with repeated anchors, each once, to their buckets; where they stand, to itself."""
        rows: list[tuple[int, int, int, bytes]] = []
        known = [np.uint64(b) << np.uint64(32) | np.frombuffer(d, np.uint32).astype(np.uint64) for b, d in _of_kind(answers, ANCHORS)]
        if left.num_rows and known:
            at, texts, ids = left["block"][0].as_py(), left["data"].to_pylist(), _ids(left["doc_id"])
            s = stretches_of(texts, length, gram)
            keys = (s.anchor % np.uint64(n)) << np.uint64(32) | (s.anchor >> np.uint64(32) & np.uint64(0xFFFFFFFE))
            s = s.of(np.flatnonzero(np.isin(keys, np.concatenate(known))))
            if len(s.doc):
                sizes = np.array([len(t) for t in texts], np.int64)
                raw = np.frombuffer(b"".join(texts), np.uint8)
                begins = (np.cumsum(sizes) - sizes)[s.doc] + s.start
                group, first = grouped(raw, begins, s, ids, length)
                # Groups are numbered by their first place in the text.
                seen, place = np.unique(group, return_index=True)
                number = np.empty(len(seen), np.int64)
                number[np.argsort(place)] = np.arange(len(seen))
                group, first = number[group], first[np.argsort(place)]
                for to, w in _by_bucket((s.anchor[first] % np.uint64(n)).astype(np.int64)):
                    f = first[w]
                    anchor, size = (s.anchor[f] >> np.uint64(32)).astype(np.uint32), s.size[f]
                    data = _squeezed(np.array([len(f)], np.int64), anchor, w.astype(np.uint32), ids[s.doc[f]], size, _bytes_at(raw, begins[f], size.astype(np.int64) + length - 1))
                    rows.append((to, at, STRETCHES, data))
                rows.append((at, at, NOTE, _squeezed(_steps(s.doc), _steps(s.start), _steps(group), s.size)))
        return _messages(rows)

    def factors(table: pa.Table) -> pa.Table:
        """To each block, of its groups with a previous factor in another block the bits of the positions."""
        rows = [(at, at, NOTE, data) for at, data in _of_kind(table, NOTE)]
        sent = _of_kind(table, STRETCHES)
        parts: list[list[np.ndarray]] = []
        for at, data in sent:
            body = _spread(data)
            m = int(body[:8].view(np.int64)[0])
            edges = np.cumsum([8, 4 * m, 4 * m, 8 * m, m])
            a, g, i, z = (body[b:e] for b, e in zip(edges, edges[1:]))
            parts.append([a.view(np.uint32), g.view(np.uint32), np.frombuffer(i.tobytes(), np.int64), z, body[edges[-1] :], np.full(m, at)])
        if parts:
            anchor, group, ids, size, raw, block = (np.concatenate(c) for c in zip(*parts))
            sizes = size.astype(np.int64) + length - 1
            begins = np.cumsum(sizes) - sizes
            order = np.argsort(anchor, kind="stable")
            edges = np.flatnonzero(np.append(True, anchor[order[1:]] != anchor[order[:-1]]))
            bits = np.zeros(len(order), np.uint32)
            b = 0
            while b < len(order):
                later = edges[np.searchsorted(edges, b + TOGETHER) :]
                e = int(later[0]) if len(later) else len(order)
                w = order[b:e]
                bits[w] = factors_of(anchor[w], ids[w], size[w], raw, begins[w], length)
                b = e
            some = np.flatnonzero(bits)
            for to, w in _by_bucket(block[some]):
                rows.append((to, 0, FACTORS, group[some[w]].tobytes() + bits[some[w]].tobytes()))
        return _messages(rows)

    def spans(left: pa.Table, answers: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, begin and end of removed strings, in order."""
        note = _of_kind(answers, NOTE)
        if not note:
            none = np.empty(0, np.int64)
            return none, none, none
        body = _spread(note[0][1])
        m = len(body) // 13
        doc, start, group = (_summed(body[k * 4 * m : (k + 1) * 4 * m]) for k in range(3))
        size = body[12 * m :]
        least = np.full(group.max() + 1, LAST)
        np.minimum.at(least, group, ids[doc])
        bits = np.zeros(len(least), np.uint32)
        for _, data in _of_kind(answers, FACTORS):
            found, its = np.frombuffer(data, np.uint32).reshape(2, -1)
            bits[found] |= its
        mine = np.where(ids[doc] > least[group], _full(size), bits[group])
        whole = mine == _full(size)
        part = np.flatnonzero(~whole & (mine > 0))
        row, place = np.nonzero(mine[part, None] >> np.arange(STRETCH, dtype=np.uint32) & np.uint32(1))
        whole = np.flatnonzero(whole)
        doc = np.concatenate([doc[whole], doc[part[row]]])
        begin = np.concatenate([start[whole], start[part[row]] + place])
        end = begin + np.concatenate([size[whole].astype(np.int64), np.ones(len(row), np.int64)]) + length - 1
        order = np.lexsort((begin, doc))
        return doc[order], begin[order], end[order]

    def finish(left: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            doc, begin, end = spans(left, answers, _ids(left["doc_id"]))
            ids, texts = left["doc_id"].to_pylist(), left["data"].to_pylist()
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, (doc_id, text) in enumerate(zip(ids, texts)):
                keep, removed, runs, at = [], 0, 0, 0
                b, e = bounds[i], bounds[i + 1]
                if e > b:
                    starts, ends = begin[b:e], np.maximum.accumulate(end[b:e])
                    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
                    for x, y in zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist()):
                        keep.append(text[at:x])
                        removed, runs, at = removed + y - x, runs + 1, y
                keep.append(text[at:])
                kept = b"".join(keep)
                row = (doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode("utf-8", "ignore")) if keep_text else row)
        columns = list(zip(*rows)) if rows else [()] * (6 if keep_text else 5)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        found = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], RESULT[: len(columns)])
        return found.append_column("carried", left["carried"]) if keep_text else found

    def in_place(answers: DataFrame, f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(f, schema)

    many = blocks.select("block", "doc_id", "data").mapInArrow(anchors, MESSAGE).groupBy("to").applyInArrow(repeated, MESSAGE)
    found = in_place(many, stretches, MESSAGE).groupBy("to").applyInArrow(factors, MESSAGE)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += f", kept string, carried {blocks.schema['carried'].dataType.simpleString()}"
    try:
        return materialize(in_place(found, finish, schema), "suffix-kept")
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, path)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with later copies of LENGTH bytes or more cut out of their texts; n_chars follows.

    A cut may fall inside a character; what is left of it is dropped.  Documents
    of which nothing is left stay, with the empty text.
    """
    cut = removed_spans(docs, keep_text=True)
    touched = F.col("n_removed") > 0
    text = F.when(touched | ~F.col("carried.__null"), F.col("kept"))
    columns = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        columns["n_chars"] = F.when(touched, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cut.select(*[c.alias(k) for k, c in columns.items()])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(read(spark, sf_dir, "documents"))


#: By the definition, over the hexadecimal digits of all strings of LENGTH bytes.
OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS x FROM d, unnest(range(n - {LENGTH - 1})) AS u(p)),
first AS (SELECT x, min(doc_id) AS least FROM s GROUP BY 1 HAVING count(*) > 1),
hits AS MATERIALIZED (SELECT doc_id, p FROM s JOIN first USING (x) WHERE least < doc_id),
runs AS (SELECT doc_id, p, sum(CASE WHEN p > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{2 * LENGTH}) AS before FROM hits)),
spans AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans UNION ALL SELECT doc_id, max(b), n FROM spans JOIN d USING (doc_id) GROUP BY doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f, t) AS k FROM gaps JOIN d USING (doc_id) GROUP BY 1),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
