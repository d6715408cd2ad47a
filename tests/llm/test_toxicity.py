import math
import zlib

import numpy as np
from rotaspark.llm import toxicity as tx
from rotaspark.llm.toxicity import LONGEST, OVERLAP, WINDOW, Network, Scorer, drop_toxic, fit, op10_toxicity, score_documents, train, window_starts, words_of

from .util import ODD, frame


def planted(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(5, 150)))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[int(rng.integers(len(words)))] = rng.choice(["xnasty", "qvile", "zzfoul" + words[0]])
        rows.append((" ".join(words), toxic))
    return rows


def test_held_out_accuracy_on_planted_words():
    net = train(planted(900, 1))
    rows = planted(300, 2)
    score = Scorer(net).scores([t for t, _ in rows])
    assert np.mean((score >= 0.7) == np.array([y for _, y in rows])) > 0.97


def test_gradients():
    net = Network(3)
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((6, 16)).astype(np.float64)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids = np.array([[1, 2, 3, 0], [4, 5, 0, 0]])
    weight = np.array([0.7, -1.3])
    loss = lambda: float(net.forward(net.gates(vectors), ids) @ weight)
    kept = net.forward(net.gates(vectors), ids, keep=True)
    grad, dgates = net.backward(ids, kept, weight, 6)
    grad |= {f"b{d}": dgates[d].sum(0) for d in (0, 1)}
    grad |= {f"x{d}": vectors.T @ dgates[d] for d in (0, 1)}
    grad["vectors"] = sum(dgates[d] @ net.w[f"x{d}"].T for d in (0, 1))
    places = net.w | {"vectors": vectors[1:]}  # row 0 stands for no word
    grad["vectors"] = grad["vectors"][1:]
    for name in ("u0", "u1", "a", "o", "b0", "b1", "x0", "x1", "vectors"):
        flat = places[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 7)):
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-4 - np.asarray(grad[name]).reshape(-1)[k]) < 2e-3


def test_windows_cover_all_words():
    for n in range(200):
        covered = {w for s in window_starts(n) for w in range(s, s + WINDOW)}
        assert set(range(n)) <= covered


def test_query(spark, sf):
    rows = op10_toxicity(spark, sf).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_documents():
    import duckdb

    rows = duckdb.sql("select d.doc_id, text, toxic from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' l using (doc_id) order by hash(doc_id)").fetchall()
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    seen = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    net = train([r for r in seen if r[1] == 1] + [r for r in seen if r[1] == 0][:800])
    got = Scorer(net).scores([t for t, _ in held]) >= 0.7
    y = np.array([y for _, y in held]) == 1
    assert (got & y).sum() / y.sum() > 0.9
    assert (got & ~y).sum() / (~y).sum() < 0.02


def test_odd(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(99, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = score_documents(docs, fit(docs, labels)).collect()
    assert len(rows) == len(ODD) and rows[0].score == rows[1].score
    assert score_documents(docs, fit(docs, labels.limit(0))).agg({"score": "max"}).first()[0] == 0
    kept = drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert drop_toxic(docs.limit(0), labels).count() == 0
    clash = docs.withColumnsRenamed({"salt": "predicted", "chunk": "score"})
    assert drop_toxic(clash, labels).columns == clash.columns and drop_toxic(clash, labels.limit(0)).first().predicted == "x"
    assert sorted(score_documents(clash, fit(clash, labels)).columns) == sorted(clash.columns)


def test_long_runs_are_read_to_their_end():
    for n in (1, 40, 41, 48, 49, 300):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        words = words_of(f"a {run} b")
        assert words[0] == "a" and words[-1] == "b" and max(map(len, words)) <= LONGEST
        read = {w[i : i + k] for w in words for k in range(1, OVERLAP + 1) for i in range(len(w) - k + 1)}
        assert {run[i : i + k] for k in range(1, OVERLAP + 1) for i in range(n - k + 1)} <= read
    assert words_of("x" * 40) == ["x" * 40]


def test_toxic_term_after_character_40_of_a_run():
    rng = np.random.default_rng(5)

    def run(toxic):
        chars = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 60, int(rng.integers(60, 300))))
        at = int(rng.integers(45, len(chars)))
        return chars[:at] + "毒毒骂" * toxic + chars[at:]

    net = train([(run(i % 3 == 0), int(i % 3 == 0)) for i in range(900)])
    y = np.arange(200) % 2 == 0
    assert np.mean((Scorer(net).scores([run(int(t)) for t in y]) >= 0.7) == y) > 0.95


def test_only_what_fits_is_trained_on(spark):
    docs = frame(spark, [c * 100 for c in "abcdefghij"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    whole, part, one = ([tuple(r) for r in tx.training_rows(docs, labels, train_chars=n).collect()] for n in (10_000, 350, 20))
    assert len(whole) == docs.filter(tx.fold() != 1).count() and part == whole[:3] and one == whole[:1]
    assert all(toxic == "abcdefghij".index(text[0]) % 2 for text, toxic in whole)
    assert tx.training_rows(docs, labels).rdd.getNumPartitions() == 1
    assert tx.fit(docs, labels.limit(0)) == 0.0 and tx.fit(docs.limit(0), labels) == 0.0 and tx.fit(docs, labels.filter("toxic = 1")) == 1.0


def plain_gru(net, words, vectors, d):
    """States of one direction, one word and one number after the other."""
    s, logistic = tx.STATE, lambda x: 1 / (1 + math.exp(-x))
    x_, u, b = (net.w[f"{k}{d}"].astype(float) for k in "xub")
    h, states = [0.0] * s, {}
    for t in range(len(words)) if d == 0 else reversed(range(len(words))):
        if words[t] is not None:
            g = [float(sum(vectors[words[t]][k] * x_[k, j] for k in range(tx.WIDTH)) + b[j]) for j in range(3 * s)]
            z = [logistic(g[j] + sum(h[k] * u[k, j] for k in range(s))) for j in range(s)]
            r = [logistic(g[s + j] + sum(h[k] * u[k, s + j] for k in range(s))) for j in range(s)]
            n = [math.tanh(g[2 * s + j] + sum(r[k] * h[k] * u[k, 2 * s + j] for k in range(s))) for j in range(s)]
            h = [(1 - z[j]) * h[j] + z[j] * n[j] for j in range(s)]
        states[t] = h
    return states


def test_scores_against_a_plain_forward_pass():
    """All windows of a text, each with attention over its own words, from the weights alone."""
    rng = np.random.default_rng(6)
    net = Network(5)
    net.table[:] = rng.standard_normal(net.table.shape).astype(np.float32) * 0.3
    for text in ("one two three", "", " ".join(f"word{k % 7}" for k in range(WINDOW + 5)), "a" * (LONGEST + 9) + " end"):
        words = words_of(text)
        found = tx.features([""] + words)
        vectors = {}
        for k, w in enumerate(words, 1):
            grams = found.grams[found.begins[k] : found.begins[k] + found.counts[k]]
            v = net.table[found.own[k]].astype(float)
            vectors[w] = v + (sum(net.table[g].astype(float) for g in grams) / math.sqrt(len(grams)) if len(grams) else 0)
        logits = []
        for start in window_starts(len(words)):
            window = [words[i] if i < len(words) else None for i in range(start, start + WINDOW)]
            both = [plain_gru(net, window, vectors, d) for d in (0, 1)]
            states = {t: np.array([*both[0][t], *both[1][t]]) for t, w in enumerate(window) if w is not None}
            score = {t: float(h @ net.w["a"]) for t, h in states.items()}
            total = sum(math.exp(x) for x in score.values())
            pooled = sum((math.exp(score[t]) / total * h for t, h in states.items()), np.zeros(2 * tx.STATE))
            logits.append(float(pooled @ net.w["o"] + net.w["c"][0]))
        want = 1 / (1 + math.exp(-max(logits)))
        assert abs(Scorer(net).scores([text])[0] - want) < 1e-4
