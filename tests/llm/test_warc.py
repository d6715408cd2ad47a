import base64
import hashlib
import io

import pytest

from rotaspark.llm.common import scratch_path
from rotaspark.llm.warc import op8_warc, read_archives, records_in, resolve, resolve_read, write_archives

SCHEMA = "page_id long, url string, html string, payload string"


def brute(pages):
    top = {}
    for i, h in pages:
        top[h or ""] = max(top.get(h or "", -1), i)
    out = []
    for i, h in pages:
        raw = (h or "").encode()
        first = top[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out)


def rows(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_pages(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows(op8_warc(spark, sf)) == brute(pages)


def test_odd_pages_round_trip(spark):
    html = ["", None, "x", "x", "WARC/1.1\r\n\r\n", "a\r\n\r\nWARC-Type: revisit", "é" * 30_000, "x", "\r\n\r\n", "日本"]
    data = [(i, None if i == 3 else "http://a b\r\nc/%d" % i, h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(data, SCHEMA)
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(df), path)
    found = read_archives(spark, path, keep_payload=True)
    assert rows(resolve_read(found.drop("payload"))) == brute(list(enumerate(html)))
    assert {r.page_id: r.payload for r in found.collect() if r.record_type == "response"} == {i: html[i] or "" for i, _, _, t, _ in brute(list(enumerate(html))) if t == "response"}


def test_archives_are_conforming(spark):
    import gzip
    import re
    from pathlib import Path

    data = [(i, f"http://host/{i}", "long text " * (1 + i % 3), "") for i in range(40)]
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(spark.createDataFrame(data, SCHEMA)), path)
    by_id, files = {}, sorted(Path(path).glob("part-*"))
    for file in files:
        found = [(h, b"".join(b)) for h, b in records_in(gzip.open(file))]
        assert [h["warc-type"] == "warcinfo" for h, _ in found] == [True] + [False] * (len(found) - 1)
        for h, block in found:
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", h["warc-record-id"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"])
            by_id[h["warc-record-id"]] = h, block
    assert len(by_id) == len(data) + len(files)  # no id twice
    pages = {int(h["page-id"]): (h, block) for h, block in by_id.values() if h["warc-type"] != "warcinfo"}
    for i, url, text, _ in data:
        h, block = pages[i]
        head, _, payload = block.partition(b"\r\n\r\n")
        assert h["content-type"].startswith("application/http") and head.startswith(b"HTTP/1.1 200")
        assert f"Content-Length: {len(text)}".encode() in head and h["warc-target-uri"] == url
        if i >= 37:
            assert (h["warc-type"], payload) == ("response", text.encode())
        else:
            first, _ = by_id[h["warc-refers-to"]]
            assert (h["warc-type"], payload, first["warc-type"]) == ("revisit", b"", "response")
            assert int(first["page-id"]) == 37 + (i - 37) % 3 and h["warc-refers-to-target-uri"] == first["warc-target-uri"]
            assert h["warc-profile"].endswith("identical-payload-digest") and h["warc-payload-digest"] == first["warc-payload-digest"]


def test_long_payload_and_several_files(spark, monkeypatch):
    from rotaspark.llm import warc

    monkeypatch.setattr(warc, "LEAST_FILE_BYTES", 100_000)
    html = ["<p>" + "x\r\n\r\n" * 600_000, "y" * 3_000_000 + "é", "z", "z"]
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(spark.createDataFrame([(i, "u", h, "") for i, h in enumerate(html)], SCHEMA)), path)
    found = read_archives(spark, path, keep_payload=True)
    assert rows(resolve_read(found.drop("payload"))) == brute(list(enumerate(html)))
    assert {r.page_id: r.payload for r in found.collect() if r.record_type == "response"} == {i: html[i] for i in (0, 1, 3)}


def test_payload_after_a_head_in_pieces():
    from rotaspark.llm.warc import payload_in

    for cut in range(1, 12):
        raw = b"H: 1\r\n\r\nab\r\n\r\nc"
        assert b"".join(payload_in(iter([raw[i : i + cut] for i in range(0, len(raw), cut)]))) == b"ab\r\n\r\nc"


def test_hot_payload_and_nothing(spark):
    df = spark.createDataFrame([(i, "u", "same", "") for i in range(300)], SCHEMA)
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(df), path)
    got = rows(resolve_read(read_archives(spark, path)))
    assert got == brute([(i, "same") for i in range(300)])
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(df.limit(0)), path)
    assert resolve_read(read_archives(spark, path)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "u", "a", ""), (1, "u", "a", ""), (None, "u", "a", ""), (2, "u", "b", "")], SCHEMA)
    path = scratch_path(spark, "warc-test")
    write_archives(resolve(df), path)
    found = read_archives(spark, path)
    assert sorted((r.page_id or 0, r.record_type) for r in found.collect()) == [(0, "revisit"), (1, "response"), (1, "response"), (2, "response")]


def test_small_payloads_stay_whole(spark):
    df = spark.createDataFrame([(i, "u", h, "") for i, h in enumerate(["a", "a", "long text", "long text"])], SCHEMA)
    assert sorted((r.page_id, r.record_type) for r in resolve(df, min_bytes=5).collect()) == [(0, "response"), (1, "response"), (2, "revisit"), (3, "response")]


def test_record_parser(monkeypatch):
    from rotaspark.llm import warc

    monkeypatch.setattr(warc, "PIECE", 3)
    one = b"WARC/1.1\r\nA: b\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    two = b"WARC/1.1\r\nContent-Length: 8\r\n\r\nWARC/1.1\r\n\r\n"
    assert [(h, b"".join(b)) for h, b in records_in(io.BytesIO(one + two))] == [({"a": "b", "content-length": "4"}, b"\r\n\r\n"), ({"content-length": "8"}, b"WARC/1.1")]
    assert [h["content-length"] for h, _ in records_in(io.BytesIO(one + two))] == ["4", "8"]
    for bad in (one[:-1], one[:-6], b"x" + one):
        with pytest.raises(ValueError):
            [b"".join(b) for _, b in records_in(io.BytesIO(bad))]
