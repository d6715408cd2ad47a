import numpy as np
import pytest
from rotaspark.llm import cover_tree
from rotaspark.llm.cover_tree import CoverTree, close_pairs, near_vectors, op9_cover_tree, unit

from .test_near_join import union

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, node string"


def brute(rows):
    by = {}
    for i, v, y in rows:
        ok = v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        by.setdefault((y, len(v)) if ok else ("alone", i), []).append((i, v))
    pairs = []
    for key, found in by.items():
        if key[0] != "alone":
            ids = [i for i, _ in found]
            u = unit(np.array([v for _, v in found], np.float64))
            a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
            pairs += [(ids[x], ids[y]) for x, y in zip(a, b)]
    ids = [r[0] for r in rows]
    root = union(ids, pairs)
    n = dict.fromkeys(ids, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], root[i], root[i] == i) for i in ids)


def found(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(op9_cover_tree(spark, sf)) == brute(rows)


@pytest.mark.parametrize("cell", [4, 1024])
def test_clusters_copies_and_odd_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    monkeypatch.setattr(cover_tree, "PIVOTS", 4)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    data = []
    for i in range(260):
        v = centres[i % 12] + rng.standard_normal(16) * rng.choice([0, 0.03, 0.1])
        data.append((i, [float(np.float32(x)) for x in v], int(i % 3), 0, "x"))
    data += [(300, None, 1, 0, ""), (301, [0.0] * 16, 1, 0, ""), (302, [float("nan")] * 16, 1, 0, ""), (303, [], 1, 0, ""), (304, data[0][1], None, 0, ""), (305, [1.0, 2.0], 0, 0, ""), (306, [2.0, 4.0], 0, 0, "")]
    df = spark.createDataFrame([d for d in data], SCHEMA)
    want = brute([(i, v, y) for i, v, y, _, _ in data])
    assert found(near_vectors(df)) == want
    assert sum(x[1] for x in want) > 100


def test_dense_cells_are_counted(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL", 6)
    monkeypatch.setattr(cover_tree, "PIVOTS", 3)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((4, 8))
    data = [(i, (centres[i % 4] + 0.002 * (i % 9) * rng.standard_normal(8)).tolist(), 1, 0, "") for i in range(200)]
    data += [(300 + i, (v * 3**i).tolist(), 1, 0, "") for i, v in enumerate(np.tile(centres[:1], (5, 1)))]
    assert found(near_vectors(spark.createDataFrame(data, SCHEMA))) == brute([d[:3] for d in data])


def written(spark):
    """Bytes written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_vectors_travel_by_bins_not_by_leaves(spark, monkeypatch):
    """Nothing rules out pairs of leaves here; before, each vector went along once for every leaf (20 MB were written)."""
    monkeypatch.setattr(cover_tree, "CELL", 32)
    rng = np.random.default_rng(9)
    data = [(i, v.tolist(), 1, 0, "") for i, v in enumerate(rng.standard_normal((3000, 16)))]
    df = spark.createDataFrame(data, SCHEMA).localCheckpoint()
    before = written(spark)
    got = found(near_vectors(df))
    assert written(spark) - before < 40 * 3000 * 128
    assert got == brute([d[:3] for d in data])


@pytest.mark.parametrize("size", [5, 60])
def test_many_bins(spark, monkeypatch, size):
    """Leaves of many bins meet; clusters are spread over leaves, nodes link as a whole, in part and not at all."""
    monkeypatch.setattr(cover_tree, "CELL", 8)
    monkeypatch.setattr(cover_tree, "PIVOTS", 3)
    monkeypatch.setattr(cover_tree, "BIN", size)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 8))
    data = [(i, (centres[i % 6] + 0.05 * (i % 5) * rng.standard_normal(8)).tolist(), i % 2, 0, "") for i in range(300)]
    data += [(400 + i, d[1], d[2], 0, "") for i, d in enumerate(data[:20])]
    data += [(500 + i, [float(np.float32(x)) for x in d[1]], d[2], 0, "") for i, d in enumerate(data[:40])]
    assert found(near_vectors(spark.createDataFrame(data, SCHEMA.replace("float", "double")))) == brute([d[:3] for d in data])


def test_very_large_and_small_numbers(spark):
    data = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [1e300, -1e300], 0), (5, [3.0, 3.0], 0)]
    rows = found(near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    assert rows == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 3, 1, False)]


def test_nothing(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dual_traversal_is_exact():
    rng = np.random.default_rng(5)
    for spread in (0.05, 0.3, 2.0):
        a = unit(np.repeat(rng.standard_normal((8, 6)), 20, 0) + spread * rng.standard_normal((160, 6)))
        b = unit(np.repeat(rng.standard_normal((8, 6)), 10, 0) + spread * rng.standard_normal((80, 6)))
        for x, y in ((a, b), (a, a)):
            i, j = close_pairs(CoverTree(x), CoverTree(y), 0.9)
            want = np.argwhere(np.einsum("ik,jk->ij", x, y) >= 0.9)
            assert {(p, q) for p, q in zip(i, j)} ^ {tuple(w) for w in want} == set()


def test_tree_covers_and_nests():
    points = unit(np.random.default_rng(6).standard_normal((200, 5)))
    tree = CoverTree(points)
    for above, level in zip(tree.levels, tree.levels[1:]):
        assert set(above[0]) <= set(level[0])
        assert len(level[1]) == len(level[0]) and level[1].max() < len(above[0])
