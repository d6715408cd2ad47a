"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents become sets of hashed shingles of five words.  Equal sets are one
node.  A node's signature of minimum hashes gives it a path of DEPTH values in
each of TREES prefix tries.

1. The tries are sorted by path (ranges of paths to tasks), and neighbours that
   share a whole path are compared by signature.  Their links join what is very
   much alike without comparing all pairs of a crowd.
2. The similarities found say how short matched prefixes must become: a pair of
   similarity s meets at k values with the chance 1 - (1 - s**k)**TREES, so each
   pair found stands for those missed at the whole path.  The prefix is shortened
   until the expected share of missed pairs falls under 1 - RECALL.
3. Nodes under one such prefix that are not joined yet are compared by signature
   (a pair far below the threshold is dropped); a prefix whose nodes are joined
   already is left out, and one of more than CROWD nodes is cut in blocks, of
   which pairs go to separate tasks.

Candidate links are joined to connected candidate groups, each node's shingle
set is sent once to its group (in blocks if the group is large), and all
pairs of a group are verified exactly: shingles that the same nodes hold are one
weighted column, and a product of matrices counts the common ones.  So a pair
is found if it meets in any trie, or if its ends are in one candidate group in
any other way.  What leaves a block is the number of links of each node and a
spanning forest.

Words are runs of word characters in lower case.  A text of one to four words
is one shingle; texts without words (null and empty ones among them) link with
nothing.  Equal sets link with each other.  Nodes are 63-bit hashes of the sets.
Null ids are allowed (their class id is null if all ids of the class are);
repeated rows are rows like any others.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.llm.common import discard, materialize, read, salt, salted_groups, salted_join, shuffle_partitions, sorted_groups, text_of
from rotaspark.llm.graph import components, forest

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.99998
#: A pair whose signatures agree in fewer of the 128 values is not sent to verification: more than four
#: standard deviations below the threshold.
MARGIN = 4.3
#: Nodes of a prefix, and of a candidate group, that one task takes; shingles of a group likewise.
CROWD, GROUP, GROUP_SHINGLES = 1024, 2048, 600_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLY = np.random.default_rng(41).integers(0, 2**64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(42).integers(0, 2**64, TREES * DEPTH, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of n words."""
    import xxhash

    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(_mixed(out))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) >> 1


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes, 16 bits of each."""
    least = np.full(TREES * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def meets(similarity: float, length: int, trees: int = TREES) -> float:
    """Chance that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(found: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that leaves the recall; found: pairs that shared a whole path, by agreeing values of their signatures.

    One pair at the threshold is supposed beside those found.  Similarities count
    a standard deviation less than the signatures say, and never below the threshold.
    """
    values = TREES * DEPTH
    pairs = [(threshold, 1.0)]
    for agreeing, n in found.items():
        x = agreeing / values
        similarity = max(threshold, x - np.sqrt(x * (1 - x) / values))
        pairs.append((similarity, n / meets(similarity, DEPTH)))
    total = sum(n for _, n in pairs)
    length = DEPTH
    while length > 1 and sum(n * (1 - meets(s, length)) for s, n in pairs) > (1 - recall) * total:
        length -= 1
    return length


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """doc_id, mark (64 bits of the text), node (null without words), n_shingles, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, sig = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, n)
                size.append(len(found))
                node.append(node_of(found) if len(found) else None)
                sig.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "mark", "node", "n_shingles", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, node long, n_shingles long, sig binary")


def _block_pairs(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """df with columns i, j: each row for every pair of blocks (i <= j) of its key that its block is in.

    A key in one block gives each row once; only a crowded key repeats rows, as often as it has blocks.
    """
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col(blocks)).cast("int")
    pair = F.transform(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return df.withColumn("block", block).withColumn("pair", F.explode(pair)).select(F.col(key).alias("key"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", *[c for c in df.columns if c not in (key, blocks)])


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _least(threshold: float) -> int:
    values = TREES * DEPTH
    return int(np.floor(values * (threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / values))))


def neighbour_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, agreeing: nodes next to each other in a sorted trie that share a whole path and look alike."""
    n = shuffle_partitions(nodes.sparkSession)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            raw = sig.astype(">u2").tobytes()
            size = 2 * DEPTH
            node, tree = np.repeat(batch.column(0).to_numpy(), TREES), np.tile(np.arange(TREES, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary()), pa.array(node)], ["tree", "path", "node"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            path = np.array(batch.column(1).to_pylist(), f"V{2 * DEPTH}")
            same = np.append(before is not None and before[:2] == (tree[0], path[0].tobytes()), (tree[1:] == tree[:-1]) & (path[1:] == path[:-1]))
            other = np.append(before[2] if before else 0, node[:-1])
            w = np.flatnonzero(same & (other != node))
            before = (tree[-1], path[-1].tobytes(), node[-1])
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[w], other[w])), pa.array(np.maximum(node[w], other[w]))], ["a", "b"])

    # The node is part of the order, so a path that very many nodes share is cut over tasks as well.
    tries = nodes.select("node", "sig").mapInArrow(paths, "tree int, path binary, node long").repartitionByRange(n, "tree", "path", "node")
    pairs = tries.sortWithinPartitions("tree", "path", "node").mapInArrow(neighbours, "a long, b long").distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("one")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("two")), "b")
    least = _least(threshold)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for k in (2, 3))
            agreeing = (one == two).sum(1)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agreeing.astype(np.int32))], ["a", "b", "agreeing"])
            yield found.filter(pa.array(agreeing >= least))

    return both.select("a", "b", "one", "two").mapInArrow(alike, "a long, b long, agreeing int")


def candidate_groups(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, component: nodes (node, sig) joined by links between those that share a prefix and look alike, as a written table."""
    n = shuffle_partitions(nodes.sparkSession)
    values, least = TREES * DEPTH, _least(threshold)
    begun = materialize(neighbour_links(nodes, threshold), "near-begun")
    # At most TREES * DEPTH + 1 rows.
    length = prefix_length({r["agreeing"]: r["n"] for r in begun.groupBy("agreeing").agg(F.count(F.lit(1)).alias("n")).collect()}, threshold)
    classes = components(begun.select("a", "b"))
    joined = nodes.select("node", "sig").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = materialize(joined, "near-joined")
    discard(classes)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)[:, :, :length]
            raw, size = np.ascontiguousarray(sig).tobytes(), 2 * length
            keys = [xxhash.xxh3_64_intdigest(raw[k : k + size], seed=k // size % TREES) - 2**63 for k in range(0, len(raw), size)]
            node, component = (np.repeat(batch.column(k).to_numpy(), TREES) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(node), pa.array(component)], ["prefix", "node", "component"])

    met = joined.select("node", "sig", "component").mapInArrow(prefixes, "prefix long, node long, component long")
    # Nodes that are joined already need not meet again.
    met = salted_groups(met, ["prefix"], "component", n, mins=("component",)).filter("group_keep > group_min_component")
    met = met.select("prefix", "node", "component", F.ceil(F.col("group_size") / CROWD).cast("long").alias("blocks"))
    met = met.join(joined.select("node", "sig"), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in sorted_groups(batches, 3):
            node, block, component = (group[c].to_numpy() for c in ("node", "block", "component"))
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, values)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = [], []
            wide, theirs = np.ascontiguousarray(sig[right]), component[right]
            for at in left:
                apart = np.flatnonzero((theirs != component[at]) & ((right > at) | (i != j)))
                alike = right[apart[(wide[apart] == sig[at]).sum(1) >= least]]
                a.append(np.full(len(alike), at))
                b.append(alike)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            root = forest(len(node), a, b)
            linked = np.flatnonzero(root != np.arange(len(node)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    later = _dealt(_block_pairs(met, "prefix", "blocks"), n).mapInArrow(link, "a long, b long")
    groups = components(begun.select("a", "b").unionByName(later).distinct())
    discard(begun)
    discard(joined)
    return groups


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common elements of the sets left and right, as a matrix."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    # Elements held by the same sets are one column with a weight.
    marks = np.random.default_rng(3).integers(0, 2**63, len(sets), dtype=np.uint64)
    mark = np.zeros(column.max() + 1, np.uint64)
    np.add.at(mark, column, marks[owner])
    held, first, weight = np.unique(mark[np.unique(column)], return_index=True, return_counts=True)
    chosen = np.unique(column)[first]
    number = np.full(column.max() + 1, -1)
    number[chosen] = np.arange(len(chosen))
    use = number[column] >= 0
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(chosen), 4096):
        b, e = np.searchsorted(column, (at, at + 4096))
        table = np.zeros((len(sets), min(4096, len(chosen) - at)), np.float32)
        table[owner[b:e], column[b:e] - at] = 1
        out += (table[left] * weight[at : at + 4096].astype(np.float32)) @ table[right].T
    return out


def verified(grouped: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, a, b) for rows (key, i, j, block, node, copies, found) sorted in groups.

    kind 0: node a has b more linked documents; kind 1: nodes a and b are linked, over some links of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in sorted_groups(batches, 3):
            node, first = np.unique(group["node"].to_numpy(), return_index=True)
            group = group.take(pa.array(first))
            block, copies = group["block"].to_numpy(), group["copies"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group["found"].to_pylist()]
            size = np.array([len(s) for s in sets])
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            links, a, b = np.zeros(len(node), np.int64), [], []
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                common = common_counts(sets, rows, right)
                both = (size[rows, None] + size[right]) * (threshold / (1 + threshold))
                r, c = np.nonzero(common >= both - 1e-3)
                keep = rows[r] < right[c] if i == j else np.ones(len(r), bool)
                r, c = rows[r[keep]], right[c[keep]]
                np.add.at(links, r, copies[c])
                np.add.at(links, c, copies[r])
                root = forest(len(node), r, c)
                linked = np.flatnonzero(root != np.arange(len(node)))
                a.append(linked)
                b.append(root[linked])
            a, b = np.concatenate(a), np.concatenate(b)
            root = forest(len(node), a, b)
            linked, some = np.flatnonzero(root != np.arange(len(node))), np.flatnonzero(links)
            kind = np.repeat([0, 1], [len(some), len(linked)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([node[some], node[linked]])), pa.array(np.concatenate([links[some], node[root[linked]]]))], ["kind", "a", "b"])

    return grouped.mapInArrow(run, "kind int, a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id reachable by links), n_links, kept (doc_id = class_id)."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    sketched = materialize(sketch(docs, id_col, text_col, words), "near-sketch")
    nodes = sketched.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    # The document whose text is read again: ids may be null or repeat, so its text's mark goes with the id.
    nodes = materialize(nodes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("mark"), "copies", "n_shingles", "sig"), "near-nodes")
    groups = candidate_groups(nodes, threshold)

    members = groups.join(nodes.drop("sig"), "node")
    members = salted_groups(members, ["component"], "node", n, sums=("n_shingles",))
    blocks = F.greatest(F.ceil(F.col("group_size") / GROUP), F.ceil(F.col("group_n_shingles") / GROUP_SHINGLES)).cast("long")
    members = members.select("component", blocks.alias("blocks"), "node", "first_id", "mark", "copies")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            mine = np.array([len(f) > 0 and node_of(f) == k for f, k in zip(found, batch.column(2).to_pylist())], bool)
            part = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f.tobytes() for f in found], pa.binary())], ["component", "blocks", "node", "copies", "found"])
            yield part.filter(pa.array(mine))

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text"))
    texts = texts.withColumn("__mark", F.xxhash64("__text"))
    fetched = texts.join(members, F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__mark") == F.col("mark"))).select("component", "blocks", "node", "copies", "__text")
    fetched = fetched.mapInArrow(sets, "component long, blocks long, node long, copies long, found binary")
    found = materialize(verified(_dealt(_block_pairs(fetched, "component", "blocks"), n), threshold), "near-links")

    classes = components(found.filter("kind = 1").select("a", "b"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    known = nodes.select("node", "first_id", "copies").join(classes, "node", "left").join(links, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    known = salted_groups(known.select("node", "first_id", "copies", "links", "component"), ["component"], "first_id", n, "min")
    known = known.select("node", F.col("group_keep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = materialize(known, "near-classes")
    for used in (nodes, groups, found, classes):
        discard(used)

    rows = sketched.select("doc_id", "node")
    linked = salted_join(rows.filter("node is not null"), known, ["node"], "doc_id", n).select("doc_id", "class_id", "n_links")
    alone = rows.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id."""
    kept = near_groups(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS l FROM documents),
k AS (SELECT doc_id, l, least(5, len(l)) AS k FROM w WHERE len(l) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i:i + k - 1], ' '))) AS x FROM k),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS m, doc_id FROM documents UNION SELECT r.m, l.b FROM reach r JOIN links l ON l.a = r.doc_id),
least_of AS (SELECT doc_id, min(m) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id = class_id AS kept FROM least_of LEFT JOIN counts USING (doc_id)
"""
