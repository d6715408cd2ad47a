import hashlib
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rotaspark.llm import bpe
from rotaspark.llm.common import read
from rotaspark.llm.packing import best_fit_plan, pack_documents

from .util import ODD, frame


def library(text):
    if not hasattr(library, "tokenizer"):
        library.tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    t = library.tokenizer
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.encode_documents(docs, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = library(texts[r.doc_id])
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), raw, decoded)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(raw), sha(decoded.encode()))


def test_odd_documents_match_the_library(spark):
    check(frame(spark, ODD))


def test_all_documents_match_the_library(spark, sf):
    check(read(spark, sf, "documents"))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 's\n\té́İß1!<|endoftext|>　日"), max_size=60))
def test_joins_are_exact_whatever_the_cut(text):
    enc = bpe.encoder(bpe.vocabulary_path())
    for mask in (1, 3, 1023):
        (ids,) = bpe.encode_chunked(enc, [text], mask)
        want, decoded = library(text)
        assert ids == np.array(want, "<u4").tobytes()
        assert enc.decode(ids) == decoded.encode()
        assert "".join(bpe.chunks_of(text, mask)) == text


def test_a_shared_chunk_is_encoded_once():
    import random

    rng = random.Random(3)
    shared = " ".join(f"word{rng.randrange(3000)}" for _ in range(3000))
    texts = [f"start {k} {shared} end {k * k}" for k in range(5)]
    enc = bpe.encoder(bpe.vocabulary_path())
    enc.clear()
    learned = []
    learn, enc.learn = enc.learn, lambda words: (learned.append(len(words)), learn(words))
    found = [*bpe.encode_chunked(enc, texts[:3]), *bpe.encode_chunked(enc, texts[3:])]
    enc.learn = learn
    assert found == [np.array(library(t)[0], "<u4").tobytes() for t in texts]
    inside = len(bpe.chunks_of(shared))
    assert inside > 10 and enc.encoded_chunks <= inside + 2 * len(texts)
    assert learned[1] < learned[0] / 3  # only the words of new chunks and of joins
    enc.clear()


def check_packing(docs, n_rows_at_most=None):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_documents(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = [*library(text)[0], 0]
        got = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 2048)))
        for r in got:
            part = ids[2048 * r.piece : 2048 * r.piece + 2048]
            assert (r.start, r.length) == (2048 * r.piece, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // 2048)


def test_packing_odd_documents(spark):
    check_packing(frame(spark, ODD))


def test_packing_is_near_the_bound(spark, sf):
    n, least = check_packing(read(spark, sf, "documents"))
    assert n <= least + 2


def test_packing_of_nothing(spark):
    assert pack_documents(frame(spark, ["x"]).limit(0)).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 40))
def test_plan_uses_as_many_sequences_as_one_by_one_best_fit(lengths, capacity):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    plan = best_fit_plan(dict(counts), capacity)
    fill, used = defaultdict(list), defaultdict(int)
    for length, rank, n, first, each, offset in plan:
        used[length] += n
        for r in range(n):
            fill[first + r // each].append((offset + r % each * length, length))
    assert used == counts
    for x in fill.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) == best_fit_decreasing(lengths, capacity)
