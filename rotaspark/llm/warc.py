"""Deduplicated WARC archives: revisit resolution by payload digest.

Record headers (id, address, digest, length) are grouped by the digest of the
payload; the record with the largest id of a group is the response, the others
become revisit records that name it, with fresh headers and no payload.  Blocks
are HTTP responses, whole for a response and the head alone for a revisit.
Records are written as text whose line separator is the end mark of a WARC
record, so Spark's own writer makes the archives in any store; each file is one
gzip stream and begins with a warcinfo record.  They are read back as files,
split by the Content-Length of each record, and revisits are joined to their
responses by record id for the page, length and digest of the full payload.

A record's id is a UUID of the run, the page and the payload, so a task that runs
again writes the same one; the page id stands in a header of its own.

Null html is an empty payload.  Null or odd urls become a urn of the record.
Ids may repeat: repeated rows with the largest id of a group are all responses,
and rows with equal ids and payloads are one record, written as often as it
comes.  Null ids count as smaller than any other; a group of null ids only stays
responses.  Very long payloads are written whole, read in pieces and never cut.
An empty table gives an archive of a warcinfo record and an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import discard, materialize, read, salt, salted_groups, scratch_path, shuffle_partitions, text_of

CRLF = "\r\n"
#: About so many bytes of records, before compression, go to one archive file, which is read back by one task.
FILE_BYTES = 256_000_000
#: As long as there are fewer files than shuffle partitions, a file may hold as little as this.
LEAST_FILE_BYTES = 8_000_000
#: Bytes of a record besides its payload, about.
HEAD_BYTES = 700
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO = f"software: rotaspark{CRLF}format: WARC File Format 1.1{CRLF}"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four characters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def target_uri(url: Column, page_id: Column) -> Column:
    """An address that fits a header line: a missing one is a urn of the page."""
    urn = F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(url), F.lit("")), urn), r"[\s\p{Cntrl}<>]", "_")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_uri."""
    n = shuffle_partitions(pages.sparkSession)
    payload = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.encode("payload", "utf-8")), "strong": F.unhex(F.sha2("payload", 256))}
    )
    headers = rows.groupBy("page_id", "strong", "payload_bytes").agg(F.max(target_uri(F.col("url"), F.col("page_id"))).alias("uri"))
    headers = headers.select("strong", "payload_bytes", F.struct("page_id", "uri").alias("header"))  # ordered by id, nulls first
    groups = salted_groups(headers, ["strong", "payload_bytes"], "header", n)
    decided = groups.select(F.col("header.page_id").alias("__id"), F.col("strong").alias("__strong"), F.col("group_keep.page_id").alias("__keep"), F.col("group_keep.uri").alias("__uri"))
    joined = rows.join(decided, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("strong") == F.col("__strong")))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__keep"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__keep")).alias("refers_to"),
        F.when(revisit, F.col("__uri")).alias("refers_to_uri"),
    )


def _urn(run: str, *parts: Column) -> Column:
    """A name-based UUID (version 5) of the run and the parts, as a record id."""
    name = F.sha1(F.concat_ws("|", F.lit(run), *[F.coalesce(p.cast("string"), F.lit("none")) for p in parts]))
    variant = F.translate(F.substring(name, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    piece = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("5"), F.substring(name, 14, 3)), F.concat(variant, F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *piece), F.lit(">"))


def write_archives(records: DataFrame, path: str) -> None:
    """Gzip-compressed WARC files; records come from resolve()."""
    spark = records.sparkSession
    run, date = uuid.uuid4().hex, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    refers = F.concat(
        F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn(run, F.col("refers_to"), F.col("payload_digest"), size),
        F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.col("refers_to_uri"), F.lit(f"{CRLF}WARC-Refers-To-Date: {date}"),
    )
    line = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), "record_type",
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(run, F.col("page_id"), F.col("payload_digest"), size),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), target_uri(F.col("url"), F.col("page_id")),
        F.lit(f"{CRLF}Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}WARC-Payload-Digest: sha1:"), "payload_digest",
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(CRLF + CRLF), http, body,
    )
    total = records.agg(F.coalesce(F.sum(F.when(revisit, 0).otherwise(F.col("payload_bytes")) + HEAD_BYTES), F.lit(0))).first()[0]
    files = int(max(1, -(-total // FILE_BYTES), min(shuffle_partitions(spark), -(-total // LEAST_FILE_BYTES))))
    info = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: "), _urn(run, F.lit("warcinfo"), F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(INFO)}{CRLF}{CRLF}{INFO}"),
    )
    # Every file begins with its warcinfo record, so files have numbers.
    first = spark.range(files).select(info.alias("value"), F.col("id").cast("int").alias("file"), F.lit(0).alias("kind"))
    then = records.select(line.alias("value"), salt(files, "page_id", "payload_bytes").alias("file"), F.lit(1).alias("kind"))
    spread = first.unionByName(then).repartitionById(files, F.col("file")).sortWithinPartitions("kind")
    spread.select("value").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


#: Bytes of a block read at a time.
PIECE = 1 << 20


def records_in(archive: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers of each record and its block in pieces, by its Content-Length; a block is read before the next record."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:20]!r} stands")
        found: dict[str, str] = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            found[name.decode().lower()] = value.strip(b" \t\r\n").decode()
        left = int(found["content-length"])

        def block() -> Iterator[bytes]:
            nonlocal left
            while left:
                piece = archive.read(min(left, PIECE))
                if not piece:
                    raise ValueError("an archive ends within a record")
                left -= len(piece)
                yield piece

        pieces = block()
        yield found, pieces
        for _ in pieces:  # what the caller left
            pass
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


def payload_in(block: Iterator[bytes]) -> Iterator[bytes]:
    """What follows the head of an HTTP response, in pieces."""
    head = b""
    for piece in block:
        head += piece
        if (end := head.find(CRLF.encode() * 2)) >= 0:
            yield head[end + 4 :]
            break
    yield from block


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """page_id, record_type, record_id, refers_to_id, url, payload_bytes and block_digest of the payload found, declared digest."""
    import gzip

    names = ["page_id", "record_type", "record_id", "refers_to_id", "url", "payload_bytes", "block_digest", "declared", *(["payload"] if keep_payload else [])]
    longs = ("page_id", "payload_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for h, block in records_in(gzip.open(pa.BufferReader(batch.column(0)[i].as_buffer()))):
                    if h["warc-type"] == "warcinfo":
                        continue
                    sha, size, kept = hashlib.sha1(), 0, []
                    for piece in payload_in(block):
                        sha.update(piece)
                        size += len(piece)
                        if keep_payload:
                            kept.append(piece)
                    digest, page = base64.b32encode(sha.digest()).decode(), h["page-id"]
                    row = (None if page == "none" else int(page), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], size, digest, h["warc-payload-digest"].removeprefix("sha1:"))
                    rows.append((*row, b"".join(kept).decode()) if keep_payload else row)
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if name in longs else pa.string()) for name, c in zip(names, columns)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{name} {'long' if name in longs else 'string'}" for name in names))


def resolve_read(found: DataFrame) -> DataFrame:
    """The records of read_archives with revisits joined to their responses.

    A response that very many revisits name is looked up once per salt.
    """
    n = shuffle_partitions(found.sparkSession)
    revisits = found.filter("record_type = 'revisit'").withColumn("__salt", salt(n, "page_id"))
    originals = found.filter("record_type = 'response'")
    # Rows that repeat are one record.
    originals = originals.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("__bytes"), F.col("block_digest").alias("__digest")).distinct()
    wanted = revisits.select("refers_to_id", "__salt").distinct().join(originals, "refers_to_id")
    joined = revisits.join(wanted, ["refers_to_id", "__salt"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    first = found.filter("record_type = 'response'").withColumns({"payload_digest": F.col("block_digest"), "refers_to": F.lit(None).cast("long")}).select(*columns)
    then = joined.withColumns({"payload_bytes": F.col("__bytes"), "payload_digest": F.col("__digest")}).select(*columns)
    return first.unionByName(then)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, records = scratch_path(spark, "warc"), materialize(resolve(read(spark, sf_dir, "pages")), "warc-records")
    write_archives(records, path)
    discard(records)
    found = materialize(read_archives(spark, path), "warc-headers")
    return resolve_read(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(x: str) -> str:
    """SQL of base32_sha1."""
    letters = []
    for i in range(8):
        bits = f"('0x' || substr(sha1({x}), {5 * i + 1}, 5))::INT"
        letters += [f"substr('{ALPHABET}', (({bits} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(letters)


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), top AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32_sql('h')} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN top USING (h)
"""
