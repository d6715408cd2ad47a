"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of its own vector and of the vectors of its character
n-grams (hashed tables) over the root of their number, so unseen words are known
by their characters, also where only a few of them tell.  Two
gated recurrent units read a window of words in both directions, attention
pools the states, and a linear layer gives the window's logit.  Runs of more
than LONGEST word characters are read as several words, overlapping pieces of
PIECE characters, so writing without blanks is read to its end.  A text is cut
into overlapping windows that cover all of it; its score is the sigmoid of the
largest window logit.

The network is trained here, in numpy, on at most TRAIN_DOCS labelled rows of
each class (those with the smallest hash of the id), all windows of each.  What
is trained is of bounded size and is broadcast; scoring is a map over documents.

Null and empty texts have one empty window and get the score of the bias.
Labels that are null or belong to no document are left out; with labels of one
class only, or none, every score is the share of toxic labels (0 if none).
Repeated ids are scored one by one; other columns are never read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import read, text_of

#: Words a window holds, and words from one window's start to the next one's.
WINDOW, STRIDE = 32, 28
#: Rows of the hashed tables, width of a word's vector, width of a state in one direction.
BUCKETS, WIDTH, STATE = 1 << 15, 16, 8
#: Labelled rows of each class that train the network, and characters of text they may hold together.
TRAIN_DOCS, TRAIN_CHARS = 1500, 12_000_000
EPOCHS, BATCH, RATE = 3, 48, 0.05
#: Steps of training at least, however few the labelled rows are.
STEPS = 200
#: Training texts that must share a row of the hashed tables for it to be trained.
SHARED = 4
THRESHOLD = 0.7
#: Characters of the longest word read as one; longer ones (writing without blanks) are read in pieces that overlap.
LONGEST, PIECE, OVERLAP = 40, 16, 8
#: Windows scored at a time, texts whose new words are learned at a time, distinct words a task remembers.
SCORE_WINDOWS, TOGETHER, MEMORY_WORDS = 2048, 256, 200_000

WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of word characters in small letters; those longer than LONGEST as overlapping pieces that cover all of them."""
    words = WORDS.findall(text.lower())
    if len(text) <= LONGEST or max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[str] = []
    for w in words:
        out += [w] if len(w) <= LONGEST else [w[at : at + PIECE] for at in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return out


class Features(NamedTuple):
    """Of each word, the table's row of its own and, one after the other, those of its n-grams."""

    own: np.ndarray
    grams: np.ndarray
    begins: np.ndarray
    counts: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        """What each of a word's n-grams counts: a few telling ones must be heard among many."""
        return (1 / np.sqrt(np.maximum(1, self.counts))).astype(np.float32)

    def of(self, which: np.ndarray) -> Features:
        counts = self.counts[which]
        ends = np.cumsum(counts)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[which] - ends + counts, counts)
        return Features(self.own[which], self.grams[place], ends - counts, counts)


def features(words: list[str]) -> Features:
    """Rows by hash: the words' own, and their 3- to 6-grams of UTF-8 bytes between marks."""
    own = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.int64) % BUCKETS
    marked = [b"<%b>" % w.encode("utf-8", "replace") for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    raw = np.frombuffer(b"".join(marked) + bytes(8), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    found, h = [], raw * np.uint64(0x100000001B3)
    for n in range(2, 7):
        h = (h[:-1] + raw[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        if n >= 3:
            at = np.flatnonzero(left >= n)
            found.append((word[at], (h[at] >> np.uint64(40)).astype(np.int64) % BUCKETS + BUCKETS))
    word = np.concatenate([w for w, _ in found])
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=len(words))
    return Features(own, np.concatenate([g for _, g in found])[order], np.cumsum(counts) - counts, counts)


def window_starts(n: int) -> range:
    """Starts of the windows that cover n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(where: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The rows of values added up by the row they belong to."""
    return np.stack([np.bincount(where, values[:, k], rows) for k in range(values.shape[1])], 1).astype(np.float32)


class Network:
    """Weights by name; word row 0 stands for no word."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.table = np.zeros((2 * BUCKETS, WIDTH), np.float32)  # rows that training doesn't reach stay silent
        self.w = {
            "x0": normal(WIDTH, 3 * STATE, scale=0.3), "u0": normal(STATE, 3 * STATE, scale=0.3), "b0": np.zeros(3 * STATE, np.float32),
            "x1": normal(WIDTH, 3 * STATE, scale=0.3), "u1": normal(STATE, 3 * STATE, scale=0.3), "b1": np.zeros(3 * STATE, np.float32),
            "a": normal(2 * STATE, scale=0.3), "o": normal(2 * STATE, scale=0.3), "c": np.full(1, -1, np.float32),
        }

    def vectors(self, f: Features) -> np.ndarray:
        """Each word's own row plus the sum of its n-gram rows over the root of their number."""
        out = self.table[f.own].copy()
        some = np.flatnonzero(f.counts)
        if len(some):
            out[some] += np.add.reduceat(self.table[f.grams], f.begins[some], 0) * f.shares[some, None]
        return out

    def step(self, h: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """One gated step; x already holds the input's part of the three gates."""
        s = STATE
        zr = np.tanh(0.5 * (x[:, : 2 * s] + h @ u[:, : 2 * s]))  # the sigmoid, by way of tanh
        zr += 1
        zr *= 0.5
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(x[:, 2 * s :] + (r * h) @ u[:, 2 * s :])
        return h + z * (n - h), z, r, n

    def forward(self, gates: list[np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of the windows in ids (words by row, 0: none); gates: by direction, the gates' inputs by row."""
        m, t_max = ids.shape
        mask = ids > 0
        full, turned = mask.all(0), np.ascontiguousarray(ids.T)
        states = np.zeros((2, t_max, m, STATE), np.float32)
        trail: list[list] = [[], []]
        for d in (0, 1):
            h, u = np.zeros((m, STATE), np.float32), self.w[f"u{d}"]
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                new, z, r, n = self.step(h, gates[d][turned[t]], u)
                if not full[t]:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    trail[d].append((t, h, z, r, n))
                h = states[d, t] = new
        both = np.concatenate([states[0], states[1]], axis=2)  # time, window, 2 states
        score = np.where(mask.T, both @ self.w["a"], -1e9)
        weight = np.exp(score - score.max(0)) * mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[..., None] * both).sum(0)
        logit = pooled @ self.w["o"] + self.w["c"][0]
        return (logit, both, weight, pooled, trail, mask) if keep else logit

    def gates(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors @ self.w[f"x{d}"] + self.w[f"b{d}"] for d in (0, 1)]

    def backward(self, ids: np.ndarray, kept: tuple, dlogit: np.ndarray, rows: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        """Gradients of the weights but x0 and x1, and of the gates' inputs by row."""
        _, both, weight, pooled, trail, mask = kept
        grad = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * self.w["o"]
        dboth = weight[..., None] * dpooled
        dweight = (both * dpooled).sum(2)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        grad["a"] = np.einsum("tm,tmk->k", dscore, both)
        dboth += dscore[..., None] * self.w["a"]
        dgates, s = [], STATE
        for d in (0, 1):
            u = self.w[f"u{d}"]
            du, each = np.zeros_like(u), np.zeros((ids.shape[1], ids.shape[0], 3 * s), np.float32)
            dh = np.zeros((ids.shape[0], s), np.float32)
            for t, h, z, r, n in reversed(trail[d]):
                on = mask[:, t, None]
                dnew = dh + dboth[t, :, d * s : (d + 1) * s]
                dn = np.where(on, dnew * z * (1 - n * n), 0)
                dz = np.where(on, dnew * (n - h) * z * (1 - z), 0)
                drh = dn @ u[:, 2 * s :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                du[:, : 2 * s] += h.T @ dzr
                du[:, 2 * s :] += (r * h).T @ dn
                dh = np.where(on, dnew * (1 - z), dnew) + drh * r + dzr @ u[:, : 2 * s].T
                each[t] = np.concatenate([dzr, dn], 1)
            dg = summed(ids.T.ravel(), each.reshape(-1, 3 * s), rows)
            dg[0] = 0
            grad[f"u{d}"] = du
            dgates.append(dg)
        return grad, dgates


def train(rows: list[tuple[str, int]], seed: int = 7) -> Network | float:
    """A network for rows of (text, label); the share of label 1 if there is one class only."""
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        return float(labels.mean()) if len(rows) else 0.0
    net, rng = Network(seed), np.random.default_rng(seed)
    known: dict[str, int] = {"": 0}
    docs, seen = [], []
    for text, _ in rows:
        ids = np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64)
        seen.append(np.unique(ids))
        docs.append(_windows(ids))
    table = features(list(known))
    # Rows that too few training texts share would only learn these texts by heart.
    in_docs = np.bincount(np.concatenate(seen), minlength=len(known)).astype(np.float64)
    rare = np.bincount(table.grams, np.repeat(in_docs, table.counts), 2 * BUCKETS) + np.bincount(table.own, in_docs, 2 * BUCKETS) < SHARED
    sums = {k: np.full_like(v, 1e-3) for k, v in net.w.items()}
    row_sums = np.full(2 * BUCKETS, 1e-3, np.float32)
    for epoch in range(max(EPOCHS, -(-STEPS * BATCH // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            windows = np.concatenate([docs[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(docs[i]) for i in chosen])
            used, local = np.unique(windows, return_inverse=True)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            local = local.reshape(windows.shape)
            words = table.of(used)
            vectors = net.vectors(words)
            vectors[0] = 0
            gates = net.gates(vectors)
            logit = net.forward(gates, local)
            # The largest window of a text speaks for it; in the first epoch also those near it.
            best = np.full(len(chosen), -np.inf, np.float32)
            np.maximum.at(best, owner, logit)
            share = np.exp((logit - best[owner]) * (1 if epoch == 0 else 8))
            total = np.zeros(len(chosen), np.float32)
            np.add.at(total, owner, share)
            share /= total[owner]
            y = labels[chosen]
            # every window of a clean text is clean; a toxic text needs one that is not
            lean = np.where(y[owner] == 1, share * (sigmoid(best) - 1)[owner], sigmoid(logit) * np.maximum(share, 1 / 64))
            live = np.flatnonzero(np.abs(lean) > 1e-4)
            if not len(live):
                continue
            kept = net.forward(gates, local[live], keep=True)
            grad, dgates = net.backward(local[live], kept, lean[live].astype(np.float32), len(used))
            dvectors = np.zeros_like(vectors)
            for d in (0, 1):
                grad[f"x{d}"], grad[f"b{d}"] = vectors.T @ dgates[d], dgates[d].sum(0)
                dvectors += dgates[d] @ net.w[f"x{d}"].T
            for k, g in grad.items():
                sums[k] += g * g
                net.w[k] -= (RATE * g / np.sqrt(sums[k])).astype(np.float32)
            g = summed(words.own, dvectors, len(net.table))
            g += summed(words.grams, np.repeat(dvectors * words.shares[:, None], words.counts, 0), len(net.table))
            g[rare] = 0
            where = np.flatnonzero(g.any(1))
            row_sums[where] += (g[where] ** 2).mean(1)
            net.table[where] -= RATE * g[where] / np.sqrt(row_sums[where])[:, None]
    return net


def _windows(ids: np.ndarray) -> np.ndarray:
    """The overlapping windows of a text's words, filled up with 0."""
    starts = np.fromiter(window_starts(len(ids)), np.int64)
    padded = np.zeros(starts[-1] + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]


class Scorer:
    """Scores texts; keeps the gates' inputs of the words seen lately."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 1
        self.gates = [np.zeros((4096, 3 * STATE), np.float32) for _ in (0, 1)]

    def learn(self, new: list[str]) -> None:
        need = self.used + len(new)
        if need > len(self.gates[0]):
            self.gates = [np.concatenate([g, np.zeros((max(need, 2 * len(g)) - len(g), 3 * STATE), np.float32)]) for g in self.gates]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for g, values in zip(self.gates, self.net.gates(self.net.vectors(features(part)))):
                g[self.used : self.used + len(part)] = values
            self.known.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Sigmoid of each text's largest window logit; words are learned and windows scored many together."""
        best = np.full(len(texts), -np.inf, np.float32)
        for first in range(0, len(texts), TOGETHER):
            if self.used > MEMORY_WORDS:
                self.clear()
            split = [words_of(text) for text in texts[first : first + TOGETHER]]
            known = self.known
            self.learn([w for w in set().union(*split) if w not in known])
            windows = [_windows(np.array([known[w] for w in words], np.int64)) for words in split]
            owner = np.repeat(np.arange(first, first + len(split)), [len(w) for w in windows])
            every = np.concatenate(windows)
            for at in range(0, len(every), SCORE_WINDOWS):
                np.maximum.at(best, owner[at : at + SCORE_WINDOWS], self.net.forward(self.gates, every[at : at + SCORE_WINDOWS]))
        return sigmoid(best.astype(np.float64))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """text, toxic: at most train_docs labelled rows of each class outside the fold 1, of train_chars characters, in hash order and in one partition."""
    marked = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    pool = marked.filter(F.col("doc_id").isNotNull()).filter(fold() != 1).withColumn("__order", F.xxhash64("doc_id", F.lit(3)))
    chosen = pool.filter("__toxic = 1").orderBy("__order").limit(train_docs).unionByName(pool.filter("__toxic = 0").orderBy("__order").limit(train_docs))
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * train_docs narrow rows
    some = found.select("__order", "doc_id", "__toxic", "text").orderBy("__order", "doc_id", "text").limit(4 * train_docs)
    order = Window.orderBy("__order", "doc_id", "text")  # 4 * train_docs rows
    chars = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = some.select("*", chars.alias("__chars"), F.row_number().over(order).alias("__place"))
    # As many whole texts as the bound on characters admits, one at least.
    admitted = placed.filter((F.col("__chars") <= train_chars) | (F.col("__place") == 1))
    return admitted.coalesce(1).sortWithinPartitions("__place").select("text", F.col("__toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Network | float:
    """The network trained on training_rows, in a task; only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(text, toxic) for batch in batches for text, toxic in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["net"])

    found = training_rows(docs, labels, train_docs, train_chars).mapInArrow(run, "net binary").first()
    return pickle.loads(found.net) if found else train([])


def score_documents(docs: DataFrame, net: Network | float, threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs and the columns score and predicted, in place of columns that docs has by these names."""
    place = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input
    columns = [c for c in docs.columns if c not in (score, predicted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = place.value
        scorer = None if isinstance(model, float) else Scorer(model)  # its words are forgotten with the task
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            found = np.full(len(texts), model) if scorer is None else scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array(found >= threshold).cast(pa.int32())], [*columns, score, predicted])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns] + [f"`{score}` double, `{predicted}` int"])
    return docs.select(*[F.col(f"`{c}`") for c in columns], text_of().alias("__text")).mapInArrow(run, kinds)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the network does not predict as toxic, columns unchanged."""
    scored = score_documents(docs, fit(docs, labels), score="__score", predicted="__predicted")
    return scored.filter("__predicted = 0").select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted")
