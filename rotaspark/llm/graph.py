"""Connected components over links that are spread over the cluster.

Alternating star contraction: every node links its larger neighbours to the
smallest of its neighbourhood, then its smaller ones, until nothing changes.  A
link {x < y} becomes {y, least neighbour of x} in the first step and {x, least
smaller neighbour of y} in the second, so links stay where they are: in blocks
dealt by the hash of the link.  A block asks once for each of its nodes, with the
least neighbour it knows itself, so a node with very many links is no single
task's.  Blocks are written to the shared folder after each step, and a lost
executor costs at most a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import discard, materialize

#: Steps after which something must be wrong; the number needed grows with the logarithm of the longest chain.
STEPS = 120
#: Links of a block (about).
BLOCK_LINKS = 100_000

STATE = "block int, changed long, data binary"
MESSAGE = "to int, at int, data binary"


def _state(block: int, changed: int, u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table([pa.array([block], pa.int32()), pa.array([changed], pa.int64()), pa.array([np.stack([u, v]).tobytes()], pa.binary())], ["block", "changed", "data"])


def _links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    u, v = np.frombuffer(data, np.int64).reshape(2, -1)
    return u, v


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])) if len(u) else np.empty(0, bool)
    return u[new], v[new]


def _begin(table: pa.Table) -> pa.Table:
    """A block's links (u > v), as a forest of stars."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(nodes), at[: len(a)], at[len(a) :])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return _state(table["block"][0].as_py(), len(linked), nodes[linked], nodes[root[linked]])


def _known(u: np.ndarray, v: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nodes a block asks for, and the least neighbour of each that it knows."""
    node, least = (np.concatenate([u, v]), np.concatenate([v, v])) if large else (u, v)
    order = np.lexsort((least, node))
    node, least = node[order], least[order]
    first = np.append(True, node[1:] != node[:-1]) if len(node) else np.empty(0, bool)
    return node[first], least[first]


def _step(state: DataFrame, large: bool, blocks: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node, least = _known(*_links(data), large)
                if not len(node):
                    continue
                to = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                order = np.argsort(to, kind="stable")
                found, begins = np.unique(to[order], return_index=True)
                parts = [np.stack([node[w], least[w]]).tobytes() for w in np.split(order, begins[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int32()), pa.array(parts, pa.binary())], ["to", "at", "data"])

    def settle(table: pa.Table) -> pa.Table:
        """The least neighbour of all, to each block that asked and knows a larger one."""
        sent = [_links(d) for d in table["data"].to_pylist()]
        at = np.repeat(table["at"].to_numpy(), [len(s[0]) for s in sent])
        node, known = (np.concatenate(c) for c in zip(*sent))
        names, number = np.unique(node, return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, number, known)
        w = np.flatnonzero(least[number] < known)
        order = w[np.argsort(at[w], kind="stable")]
        found, begins = np.unique(at[order], return_index=True)
        parts = [np.stack([node[k], least[number[k]]]).tobytes() for k in np.split(order, begins[1:])] if len(found) else []
        return pa.table([pa.array(found, pa.int32()), pa.array([0] * len(found), pa.int32()), pa.array(parts, pa.binary())], ["to", "at", "data"])

    def take(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary())], ["block", "changed", "data"])
        u, v = _links(left["data"][0].as_py())
        node, least = _known(u, v, large)
        least = least.copy()
        for data in answers["data"].to_pylist():
            asked, found = _links(data)
            least[np.searchsorted(node, asked)] = found
        if large:  # the larger end goes to the least of the smaller end's neighbourhood
            one, two = u, np.minimum(v, least[np.searchsorted(node, v)]) if len(u) else v
        else:  # the smaller end goes to the least of the larger end's smaller neighbours
            top = least[np.searchsorted(node, u)] if len(u) else v
            one, two = np.where(v == top, u, v), top
            one, two = np.maximum(one, two), np.minimum(one, two)
        new_u, new_v = _distinct(one, two)
        old_u, old_v = _distinct(u, v)
        same = len(new_u) == len(old_u) and (new_u == old_u).all() and (new_v == old_v).all()
        return _state(left["block"][0].as_py(), int(not same), new_u, new_v)

    sent = state.select("block", "data").mapInArrow(send, MESSAGE).groupBy("to").applyInArrow(settle, MESSAGE)
    following = materialize(state.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(take, STATE), "components")
    discard(state)
    return following


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node of it) for the ends of links(a long, b long), as a written table; a node may link itself."""
    given = materialize(links.select("a", "b"), "links")
    blocks = max(1, -(-given.count() // BLOCK_LINKS))
    dealt = given.filter("a <> b").withColumn("block", F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).cast("int"))
    state = materialize(dealt.groupBy("block").applyInArrow(_begin, STATE), "components")
    still = 0
    for step in range(STEPS):
        state = _step(state, step % 2 == 0, blocks)
        still = 0 if state.agg(F.sum("changed")).first()[0] else still + 1
        if still == 2:
            break
    else:
        raise RuntimeError("components did not settle")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                u, v = _links(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([v, v]))], ["node", "component"])

    found = state.select("data").mapInArrow(ends, "node long, component long")
    alone = given.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    settled = materialize(found.unionByName(alone).groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(state)
    discard(given)
    return settled


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 linked by the pairs (a, b), the smallest node each is linked to, over any number of links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
