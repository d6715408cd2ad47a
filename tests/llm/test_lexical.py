import math
import re
from collections import Counter, defaultdict

import numpy as np

from rotaspark.llm import lexical as lx
from rotaspark.llm.common import read

from .util import ODD, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, top):
    each = [(i, c) for i, c in ((i, cut(t)) for i, t in docs) if c]
    n, words = len(each), sum(c.total() for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, c in each:
            m = 50 + 50 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in cut(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def check(docs, items, top=lx.TOP):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], top)
    assert sorted(map(tuple, lx.ranked_search(docs, items, top).collect()), key=repr) == want
    return want


def test_given_tables(spark, sf):
    assert check(read(spark, sf, "documents"), read(spark, sf, "benchmark"), 7)


def items_of(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in texts], "item_id long, text string, query string")


def test_odd_texts_ties_and_null_ids(spark):
    docs = frame(spark, ODD + ["the cat", "cat the", "THE cat"]).unionByName(frame(spark, ["the cat", "cat"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "salt", "chunk"))
    items = items_of(spark, [(1, "The cat; the"), (2, None), (3, ""), (4, "日本語 word"), (1, "The cat; the"), (None, "é 42 cat"), (5, "absent")])
    want = check(docs.unionByName(docs.filter("doc_id = 6")), items, 5)
    assert {r[0] for r in want} == {1, 4, None}


def test_empty_tables(spark):
    docs, items = frame(spark, ["a b"]), items_of(spark, [(1, "a")])
    assert lx.ranked_search(docs.limit(0), items).count() == 0 and lx.ranked_search(docs, items.limit(0)).count() == 0
    assert lx.ranked_search(frame(spark, [None, " - "]), items).count() == 0


def test_blocks_of_queries_and_small_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(lx, "QUERY_BYTES", 3000)
    items = read(spark, sf, "benchmark")
    assert lx._blocks(items, "item_id", "text")[1] > 2
    check(read(spark, sf, "documents"), items, 3)


def test_search_skips_nothing_that_counts():
    """Random lists, shard after shard, against plain sums."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        best, sums = lx.Best(8), defaultdict(int)
        for shard in range(3):
            n = int(rng.integers(1, 400))
            lists = []
            for k in range(int(rng.integers(1, 9))):
                places = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.05, 0.5, 0.9]))
                if len(places):
                    lists.append((places, rng.integers(1, int(rng.choice([3, 50, 1000])), len(places))))
                    for p, v in zip(*lists[-1]):
                        sums[1000 * shard + p] += v
            if lists:
                lx.search(lists, n, 1000 * shard + np.arange(n), np.zeros(n, bool), best, int(rng.choice([1, 8, 16])), int(rng.choice([7, 64, 2048])))
        want = sorted((-v, k) for k, v in sums.items())[:8]
        assert [(-s, i) for s, i in zip(best.score.tolist(), best.ids.tolist())] == want


def test_pieces_of_a_long_text():
    text = " ".join(f"w{k % 97}" for k in range(5000)).encode()
    assert lx.terms(text, 100) == lx.terms(text) and len(lx.terms(text)) == 97
    assert lx.terms(b"a" * 1000, 10) == {b"a" * 1000: 1}
