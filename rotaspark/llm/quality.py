"""Quality rules: counts of each text alone, then lines that recur in the documents of a host.

One pass over the texts measures each and hashes its normalised lines (ASCII
letters lower-cased, every digit 0, words one blank apart).  A line's documents
are counted by host, each document once, with partial counts before the shuffle.
Lines above the limits are removed, and a document that less than half of its
word characters are left of is rejected.  A common line is a hot key by nature:
it is one row on its side of the join, so Spark may split the other side.

Null text is the empty text and fails the base rules; null hosts are one host.
Ids may be null or repeat: every row is a document of its own.  Texts of any
length are read whole, their words a piece at a time.  An empty table gives an
empty result.  Other columns are not looked at and cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import materialize, read

#: Base rules: words at least, and words in repeated windows at most, in percent.
MIN_WORDS, REPEATED_PERCENT = 50, 50
#: A line goes where it is in more than so many documents of its host and in more than this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.001
#: Percent of its word characters that a document must keep.
LEFT_PERCENT = 50
#: Words a window.
WINDOW = 3
#: White space between words, symbols counted.
SPACE, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
#: Bytes that continue a code point.
TAIL = bytes(range(0x80, 0xC0))
DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
#: Bytes of a text whose words are cut at once, and words from which windows are compared as numbers.
PIECE, MANY = 1 << 20, 20_000

MEASURED = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<a:long,b:long,chars:long>>"


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """text in pieces of about `size` bytes that end between words."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def repeated_words(text: bytes) -> tuple[int, int]:
    """Words, and those of them that lie in a window found twice or more."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in piece.split()), np.int64) for piece in pieces(text)] if len(text) > PIECE else []
    words = [] if ids else text.split()
    n = sum(map(len, ids)) if ids else len(words)
    if n <= WINDOW:
        return n, 0
    if not ids and n < MANY:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return n, 0
        found = Counter(windows)
        again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    else:
        each = np.concatenate(ids) if ids else np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        name = each
        for k in range(1, WINDOW):  # names of pairs, of triples: exact, and below the square of the words
            name = np.unique(name[:-1] * (len(number) + 1) + each[k:], return_inverse=True)[1]
        again = np.bincount(name)[name] > 1
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return n, int(covered.sum())


def word_chars(text: bytes) -> int:
    return len(text.translate(None, SPACE + TAIL))


def measure(text: bytes) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and word characters by normalised line."""
    n, repeated = repeated_words(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars: dict[bytes, int] = {}
    for line in lines:
        key = normalised(line)
        chars[key] = chars.get(key, 0) + word_chars(line)
    return n, word_chars(text), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, chars


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(DIGITS).split())


def digest(line: bytes) -> tuple[int, int]:
    """128 bits of a normalised line as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(line)
    return tuple((y ^ (1 << 63)) - (1 << 63) for y in (x >> 64, x & ((1 << 64) - 1)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats, a, b, chars, ends = [], [], [], [], [0]
        for text in batch.column(2):
            *found, lines = measure(text.as_py() or b"")
            stats.append(found)
            for line, count in lines.items():
                one, two = digest(line)
                a.append(one)
                b.append(two)
                chars.append(count)
            ends.append(len(a))
        each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (a, b, chars)], ["a", "b", "chars"])
        columns = [pa.array(c, pa.int64()) for c in zip(*stats)] if stats else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row a document with its counts and line hashes, written to the shared folder; row numbers it."""
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.col(text_col).cast("binary").alias("text"))
    return materialize(texts.mapInArrow(_measured, MEASURED).withColumn("row", F.monotonically_increasing_id()), "quality")


def common_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, a, b, n: the lines of measured rows that are in too many documents of their host."""
    found = rows.select("host", F.inline("lines")).groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line_docs)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return found.join(hosts, "host").filter(F.col("n") > line_share * F.col("docs")).select("host", "a", "b", "n")


def judge(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Measured rows with removed_chars, base_failed and kept."""
    gone = rows.select("row", "host", F.inline("lines")).join(common, ["host", "a", "b"]).groupBy("row").agg(F.sum("chars").alias("removed_chars"))
    met = rows.drop("lines").join(gone, "row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = 100 * (F.col("word_chars") - F.col("removed_chars")) >= LEFT_PERCENT * F.col("word_chars")
    return met.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """doc_id, the counts, removed_chars, base_failed, kept: one row per row of docs."""
    rows = measured(docs)
    found = judge(rows, common_lines(rows, line_docs, line_share))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars", "base_failed", "kept")


def clean_documents(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """The documents that are kept, with all their columns, and their texts without the common lines."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "quality-docs")
    rows = measured(numbered, id_col="__row").withColumn("row", F.col("doc_id"))
    common = common_lines(rows, line_docs, line_share)
    kept = judge(rows, common).filter("kept").select(F.col("row").alias("__row"))
    gone = rows.select("row", "host", F.inline("lines")).join(common, ["host", "a", "b"]).groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("a", "b")).alias("__gone"))  # lines of one document
    met = numbered.join(kept, "__row").join(gone, "__row", "left")
    names, place = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if found:
                    out_of = {(x["a"], x["b"]) for x in found}
                    text = "\n".join(line for line in text.split("\n") if digest(normalised(line.encode())) not in out_of)
                out.append(text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.select(*docs.columns, "__gone").mapInArrow(cut, docs.schema)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
g AS (SELECT r, i, word, lead(word) OVER o AS two, lead(word, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, two, three) AS n FROM g WHERE three IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2]) AS q(k) GROUP BY r),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, source, line, length(regexp_replace(line, '{_SPACE}+', '', 'g')) AS chars,
    trim(regexp_replace(translate(line, '{_UPPER}123456789', '{_LOWER}000000000'), '{_SPACE}+', ' ', 'g'), ' ') AS norm
  FROM l WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY r),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
common AS (SELECT n.source, norm FROM n JOIN hosts ON n.source IS NOT DISTINCT FROM hosts.source GROUP BY n.source, norm, docs
  HAVING count(DISTINCT r) > {LINE_DOCS} AND count(DISTINCT r) > {LINE_SHARE}::DOUBLE * docs),
gone AS (SELECT r, sum(chars) AS removed_chars FROM n JOIN common ON n.source IS NOT DISTINCT FROM common.source AND n.norm = common.norm GROUP BY r),
f AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_chars, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * (word_chars - removed_chars) >= {LEFT_PERCENT} * word_chars AS kept FROM j
"""
