import hashlib
import os
import random

from rotaspark.llm import suffix_dedup as sd
from rotaspark.llm.common import delete, read
from rotaspark.llm.suffix_dedup import cut_repeats, op4_suffix_dedup, removed_spans

from .util import ODD, frame


def brute(rows, length=50):
    """By the definition: the smallest id at which each string of `length` bytes starts."""
    first = {}
    data = [(i if i is not None else 2**63, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((2**63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def check(docs):
    got = found(removed_spans(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_documents(spark, sf):
    want = brute([(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()])
    assert found(op4_suffix_dedup(spark, sf)) == want
    assert sum(x[2] for x in want) > 1000


def test_odd(spark):
    check(frame(spark, ODD + ["ab" * 400, "b" + "ab" * 300, "a" * 49, "a" * 50]))


def test_overlapping_and_nested_copies(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            at = rng.randrange(250)
            parts.append(b[at : at + rng.randrange(20, 120)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(0, 40))))
        texts.append("".join(parts))
    assert sum(x[2] for x in check(frame(spark, texts))) > 1000


def test_hot_passage_in_all_documents(spark):
    rng = random.Random(6)
    junk = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = junk(70)
    check(frame(spark, [junk(rng.randrange(60)) + passage + junk(rng.randrange(60)) for _ in range(200)]))


def test_repeated_and_null_ids(spark):
    docs = frame(spark, ["q" * 10 + "w%d" % (i // 2) * 60 for i in range(8)]).selectExpr("if(doc_id > 5, null, doc_id div 2) doc_id", "text", "lang")
    check(docs)
    assert removed_spans(docs.limit(0)).count() == 0


def test_cut_keeps_columns_and_whole_characters(spark):
    docs = frame(spark, ["é" * 40 + "tail", "xx" + "é" * 40, None, "short"])
    rows = sorted(cut_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert cut_repeats(docs).columns == docs.columns
    assert [r.text for r in rows] == ["é" * 40 + "tail", "xx", None, "short"]
    assert [r.n_chars for r in rows] == [44, 2, 0, 5]


def test_long_documents_in_slices(spark, monkeypatch):
    from rotaspark.llm import suffix_dedup

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    texts = [t.encode() for t in (long, "", "short", long[500:1800] + "x", "y" + long, "ab" * 300)]

    def anchors():
        s = suffix_dedup.stretches_of(texts)
        return {(d, p + k): a for d, p, n, a in zip(*[c.tolist() for c in s[:4]]) for k in range(n)}

    want = anchors()
    assert len(want) == sum(max(0, len(t) - 49) for t in texts)
    for size in (50, 97, 1000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        assert anchors() == want
    monkeypatch.undo()
    check(frame(spark, ["x" + "".join(rng.choice("abcdefgh") for _ in range(1_060_000)), "z" * 60] * 2))


def test_unequal_bytes_under_one_name(monkeypatch):
    import numpy as np
    from rotaspark.llm.suffix_dedup import grouped, stretches_of

    texts = [b"a" * 50 + bytes([k]) * 70 for k in (1, 2, 1)]
    s = stretches_of(texts)
    same = s._replace(name=np.zeros_like(s.name), anchor=np.zeros_like(s.anchor))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.array([0, 120, 240])[s.doc] + s.start
    group, first = grouped(raw, begins, same, np.array([5, 6, 7]), 50)
    strings = [bytes(raw[b : b + n + 49]) for b, n in zip(begins, s.size.astype(int))]
    for k, g in enumerate(group):
        assert strings[first[g]] == strings[k]


def test_previous_smaller():
    import numpy as np
    from rotaspark.llm.suffix_dedup import previous_smaller

    rng = np.random.default_rng(2)
    for _ in range(50):
        ids, agrees = rng.integers(0, 9, 40), rng.random(40) < 0.8
        agrees[0] = False
        want = []
        for i in range(40):
            j = i
            while agrees[j] and ids[j - 1] >= ids[i]:
                j -= 1
            want.append(j - 1 if agrees[j] else -1)
        assert previous_smaller(ids, agrees).tolist() == want


def test_blocks_lie_in_the_shared_folder_and_go(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sd, "delete", lambda spark, path: (seen.append((path, os.path.isdir(path))), delete(spark, path)))
    sd.removed_spans(frame(spark, ["a" * 80, "b" * 80, "a" * 80])).collect()
    assert [there for path, there in seen] == [True] and seen[0][0].startswith(spark.conf.get("spark.checkpoint.dir")) and not os.path.exists(seen[0][0])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_blocks")]
