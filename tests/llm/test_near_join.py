import random
import re
from collections import defaultdict

import numpy as np
from rotaspark.llm.common import read
from rotaspark.llm.graph import components, forest
from rotaspark.llm.near_join import common_counts, drop_near_copies, meets, near_groups, op2_ngram_jaccard, prefix_length

from .util import ODD, frame


def union(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def words_shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    size = min(5, len(words))
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []


def brute(rows):
    sets = {i: set(words_shingles(t)) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    linked = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = union(list(sets), linked)
    n = defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    return sorted((i, root[i], n[i], root[i] == i) for i in sets)


def found(df):
    return sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in df.collect())


def test_documents(spark, sf):
    want = brute([(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()])
    assert found(op2_ngram_jaccard(spark, sf)) == want
    assert sum(x[2] for x in want) > 10


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_odd_and_hot_group(spark):
    docs = frame(spark, [*ODD, *near_copies(250), "one two three", "one two three", "One, two; three!"])
    assert found(near_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_blocks_of_a_crowded_group(spark, monkeypatch):
    from rotaspark.llm import near_join

    monkeypatch.setattr(near_join, "CROWD", 20)
    monkeypatch.setattr(near_join, "GROUP", 30)
    docs = frame(spark, near_copies(150, 4))
    assert found(near_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dropping_keeps_columns_and_clean_documents(spark):
    docs = frame(spark, ["a b c d e f g h", "A b c d e f g h", None, "", "q w e r t y"])
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert near_groups(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = frame(spark, ["a b c d e f"] * 3).selectExpr("if(doc_id = 1, null, 7L) doc_id", "text")
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in near_groups(docs).collect()) == [(0, 7, 2), (7, 7, 2), (7, 7, 2)]


def test_prefixes_shorten_with_what_was_found():
    assert prefix_length({}) == 3
    assert meets(0.8, 3) >= 1 - 2e-5 > meets(0.8, 4)
    assert prefix_length({128: 10**9}) == 8
    lengths = [prefix_length({k: 10**6}) for k in (104, 112, 120, 126)]
    assert lengths == sorted(lengths) and lengths[0] == 3 and lengths[-1] > 4


def test_recall_over_all_documents(spark):
    """Ids divisible by 20 against all rows, found by shared shingles."""
    rows = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()]
    sets = {i: set(words_shingles(t)) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    want = {(i, j) for i in sets if i % 20 == 0 for j in set().union(*[holders[x] for x in sets[i]]) if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    class_of = {r.doc_id: (r.class_id, r.n_links) for r in op2_ngram_jaccard(spark, "/root/testdata/sf0.1").collect()}
    assert len(want) > 20 and all(class_of[i][0] == class_of[j][0] for i, j in want)
    links = defaultdict(int)
    for i, _ in want:
        links[i] += 1
    assert {i: class_of[i][1] for i in sets if i % 20 == 0} == {i: links[i] for i in sets if i % 20 == 0}


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(25)]
    got = common_counts(sets, np.arange(10), np.arange(25))
    assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:10]])[~np.eye(10, 25, dtype=bool)].all()


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(200)]
    other = [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(40)]
    pairs = [*chain, *star, *other, (5000, 5000)]
    want = union({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    a, b = np.array(other).T - 2000
    root = forest(60, a, b)
    for x, y in zip(a, b):
        assert root[x] == root[y]
    assert {2000 + i: 2000 + int(root[i]) for i in range(60) if 2000 + i in want} == {k: v for k, v in want.items() if 2000 <= k < 2060}


def test_many_null_ids(spark):
    """Texts are told apart by more than their ids: pairs of near copies, all without an id."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = frame(spark, [words(k // 2) + (" more" if k % 2 else "") for k in range(120)]).selectExpr("if(doc_id < 110, null, doc_id) doc_id", "text")
    rows = near_groups(docs).collect()
    assert len(rows) == 120 and all(r.n_links == 1 for r in rows)
    assert sorted(r.class_id for r in rows if r.doc_id is not None) == [110 + k // 2 * 2 for k in range(10)]
