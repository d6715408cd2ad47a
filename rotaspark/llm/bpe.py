"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts texts into chunks at places that depend on a few bytes
around them only, so texts that share a passage share chunks.  Texts are dealt
by their smallest chunk hash, which brings texts that share most of their
chunks to the same task; a task encodes each distinct chunk once, all new chunks
of a batch together, and takes the ids of chunks it knows from its table.  The
cut falls anywhere, so the two ends of a chunk are provisional: at every join the
stretch between the last white space before it and the first one after it is
encoded again as one piece.  Tokens of the vocabulary never span white space,
so at those two places the new tokens and the chunk's own agree exactly; a
chunk without white space is swallowed and the stretch goes on to the next.

Null text is the empty text and gives no tokens.  Rows are treated one by one:
repeated or null ids, ties and other columns have no effect.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import read, shuffle_partitions, text_of

VOCABULARY = "word_bpe_49k.json"
#: A chunk ends where the low bits of the rolling hash are all ones: about 1 KiB apart.
CUT_MASK = 1023
#: Bytes the rolling hash looks back over (a power of two).
CUT_WINDOW = 32
#: About so many bytes of words and chunks a worker remembers before it starts afresh; texts whose new words it learns together.
MEMORY_BYTES, TOGETHER = 100_000_000, 512
_GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters only are split here; case, composition and the split's classes are plain for them.
SIMPLE = re.compile(r"[\n\t\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's split of such a text in lower case (fixed values: the contractions).
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Longest piece, in bytes, that is merged together with others.
PIECE_BYTES = 48
_NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges of many pieces at a time: in each round every piece makes its best merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left, bits = np.arange(len(key)), 18
        while len(left):  # what collides goes to the next, smaller table
            shift = np.uint64(64 - bits)
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
            slot = self._slot(key[left], shift)
            keys[slot], ranks[slot] = key[left], left
            self.levels.append((shift, keys, ranks))
            left, bits = left[keys[slot] != key[left]], max(8, bits - 2)
        # pairs of first symbols: the letters' ids are the smallest ones, -1 stands for none
        base = int(max(self.inner.max(), self.last.max())) + 2
        a, b = np.divmod(np.arange(base * base), base)
        self.first = self.rank(a - 1, b - 1).reshape(base, base)

    @staticmethod
    def _slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((key.view(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) + (shift << np.uint64(33)))) >> shift).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; _NONE if there is none or either is -1."""
        key = a.astype(np.int64) << 16 | b
        key[b < 0] = -2
        out = np.full(len(key), _NONE, np.int32)
        for shift, keys, ranks in self.levels:
            slot = self._slot(key, shift)
            hit = keys[slot] == key
            out[hit] = ranks[slot[hit]]
        return out

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (1 to PIECE_BYTES bytes) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for low, high in ((1, 4), (5, 8), (9, 12), (13, 18), (19, 28), (29, PIECE_BYTES)):
            group = np.flatnonzero((sizes >= low) & (sizes <= high))
            for at in range(0, len(group), 8192):
                self._merge(pieces, group[at : at + 8192], sizes, high, out)
        return out

    def _merge(self, pieces: list[bytes], which: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        n = sizes[which]
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in which]), np.uint8).reshape(-1, width)
        column = np.arange(width)
        symbols = np.where(column < n[:, None], self.inner[raw], -1)
        symbols[np.arange(len(n)), n - 1] = self.last[raw[np.arange(len(n)), n - 1]]
        symbols = np.pad(symbols, ((0, 0), (0, 1)), constant_values=-1)
        ranks = np.pad(self.first[symbols[:, :-1] + 1, symbols[:, 1:] + 1], ((0, 0), (0, 1)), constant_values=_NONE)
        column = np.arange(width + 1)
        while len(which):
            row = np.arange(len(which))
            best = ranks.argmin(1)
            rank = ranks[row, best]
            done = rank == _NONE
            if done.any():
                ended = np.flatnonzero(done)
                counts = (symbols[ended] >= 0).sum(1)
                for i, s, k in zip(which[ended].tolist(), symbols[ended].astype("<u4"), counts.tolist()):
                    out[i] = s[:k].tobytes()
                go = ~done
                which, symbols, ranks, best, rank = which[go], symbols[go], ranks[go], best[go], rank[go]
                row = np.arange(len(which))
                if not len(which):
                    break
            shift = np.minimum(column + (column > best[:, None]), width)
            symbols = np.take_along_axis(symbols, shift, 1)
            ranks = np.take_along_axis(ranks, shift, 1)
            new = self.merged[rank]
            symbols[row, best] = new
            ranks[row, best] = self.rank(new, symbols[row, np.minimum(best + 1, width)])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.rank(symbols[left, best[left] - 1], new[left])


class Encoder:
    """Ids (little-endian unsigned 32-bit) and decoded text of a text.

    The vocabulary's tokens never span the pieces of its split, so the ids of a
    text are those of its pieces in order, and each distinct piece is encoded
    once.  Texts of plain characters are split here; others go word by word
    (between blanks and line feeds, which give no token and join nothing)
    through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(path)
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        shown = [f"{names[i]} ".encode() if i in names else b"" for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.name_sizes = np.array([len(x) for x in shown])
        self.name_begins = np.cumsum(self.name_sizes) - self.name_sizes
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.kept = self.encoded_chunks = 0

    def forget(self) -> None:
        if self.kept > MEMORY_BYTES:
            self.clear()

    def learn(self, words: set[str]) -> None:
        """Encode new words together."""
        new = [w for w in words if w not in self.words]
        plain, other = [], []
        for w in new:
            (plain if SIMPLE.fullmatch(w) and "<|" not in w else other).append(w)
        split = [PIECES.findall(w.lower()) for w in plain]
        pieces = self.pieces
        fresh = list({p for parts in split for p in parts if p not in pieces})
        raw = [p.encode() for p in fresh]
        short = [k for k, r in enumerate(raw) if len(r) <= PIECE_BYTES]
        for k, ids in zip(short, self.merges.ids([raw[k] for k in short])):
            pieces[fresh[k]] = ids
        if len(short) < len(raw):
            self._through_library([p for p, r in zip(fresh, raw) if len(r) > PIECE_BYTES], pieces)
        for w, parts in zip(plain, split):
            self.words[w] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        if other:
            self._through_library(other, self.words)
        self.kept += sum(map(len, new)) + 170 * len(new) + 150 * len(fresh)

    def _through_library(self, new: list[str], known: dict[str, bytes]) -> None:
        for word, found in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            known[word] = np.array(found.ids, "<u4").tobytes()

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The texts' words, all of them learned."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self.learn(set().union(*split))
        return split

    def joined(self, words: list[str]) -> bytes:
        known = self.words
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decoding: without a decoder it joins the tokens by blanks."""
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        size = self.name_sizes[at]
        end = np.cumsum(size)
        place = np.arange(end[-1]) + np.repeat(self.name_begins[at] - end + size, size)
        return self.name_bytes[place][:-1].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_places(data: bytes, mask: int = CUT_MASK) -> np.ndarray:
    """Byte offsets at which content-defined chunks of UTF-8 data end, the end of the data excluded."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    span = 1
    while span < CUT_WINDOW:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint32(span) if span < len(h) else 0
        h, span = wider, 2 * span
    ends = np.flatnonzero((h >> np.uint32(11) & np.uint32(mask)) == mask) + 1
    ends = ends[ends < len(raw)]
    return ends[(raw[ends] & 0xC0) != 0x80]


def chunks_of(text: str, mask: int = CUT_MASK) -> list[str]:
    data = text.encode("utf-8", "surrogatepass")
    ends = [0, *cut_places(data, mask).tolist(), len(data)]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]


def _safe(chunk: str) -> tuple[int, int]:
    """Places of the first and the last blank or line feed; (-1, -1) if there is none."""
    first = [i for i in (chunk.find(" "), chunk.find("\n")) if i >= 0]
    return (min(first), max(chunk.rfind(" "), chunk.rfind("\n"))) if first else (-1, -1)


class Plan(NamedTuple):
    """A text as its chunks with white space and the stretches around them: one stretch more than chunks."""

    chunks: list[str]
    stretches: list[str]


def plan_of(text: str, mask: int = CUT_MASK) -> Plan:
    chunks, stretches, open_end = [], [], ""
    for chunk in chunks_of(text, mask):
        first, last = _safe(chunk)
        if first < 0:  # no agreement inside this chunk: the stretch goes on
            open_end += chunk
            continue
        chunks.append(chunk)
        stretches.append(open_end + chunk[:first])
        open_end = chunk[last + 1 :]
    return Plan(chunks, [*stretches, open_end])


def encode_chunked(enc: Encoder, texts: list[str], mask: int = CUT_MASK) -> list[bytes]:
    """Ids of texts out of their chunks' and the repaired joins'; chunks that are not known are encoded once, together."""
    plans = [plan_of(text, mask) for text in texts]
    new = list({c: None for p in plans for c in p.chunks if c not in enc.chunks})
    bodies = []
    for chunk in new:
        first, last = _safe(chunk)
        bodies.append(chunk[first : last + 1])
    words = enc.prepare([*bodies, *[s for p in plans for s in p.stretches]])
    for chunk, found in zip(new, words):
        enc.chunks[chunk] = enc.joined(found)
        enc.kept += 6 * len(chunk) + 200
    enc.encoded_chunks += len(new)
    joins, out = iter(words[len(new) :]), []
    for plan in plans:
        ids = [enc.joined(next(joins))]
        for chunk in plan.chunks:
            ids += [enc.chunks[chunk], enc.joined(next(joins))]
        out.append(b"".join(ids))
    return out


def least_chunk(text: str) -> int:
    """A text's smallest chunk hash: equal for copies, and for near copies mostly."""
    import xxhash

    data = text.encode("utf-8", "surrogatepass")
    ends = [0, *cut_places(data).tolist(), len(data)]
    return min(xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])) - 2**63


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (binary) and decoded."""
    path = path or vocabulary_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6 if keep_ids else 4)]
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), TOGETHER):
                enc.forget()
                for doc_id, ids in zip(ids_of[at : at + TOGETHER], encode_chunked(enc, texts[at : at + TOGETHER])):
                    decoded = enc.decode(ids)
                    row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded)
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], list(names[: len(out)]))
        enc.clear()  # the worker lives on

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return _dealt_by_chunk(rows).mapInArrow(run, schema)


def _dealt_by_chunk(rows: DataFrame) -> DataFrame:
    """Rows that share their smallest chunk, together, unless they are too many for one task.

    REBALANCE lets Spark split the partition of a chunk that very many texts share.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([least_chunk(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["doc_id", "text", "chunk"])

    n = shuffle_partitions(rows.sparkSession)
    marked = rows.mapInArrow(keyed, "doc_id long, text string, chunk long")
    return marked.hint("rebalance", n, F.col("chunk")).select("doc_id", "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
