"""Near-dedup of embeddings by a dual traversal of cover trees.

Vectors of one label are compared by cosine.  On unit vectors a cosine of at
least t is a distance of at most sqrt(2 - 2t), so metric bounds apply.

The upper levels of the tree are built with Spark, one level a round: a cell of
more than CELL vectors is cut by up to PIVOTS of them and its own centre (a centre
stays one), every vector joins its nearest centre, and a cell's covering radius is
its largest distance.  Both sides of the tree are descended with it: the pairs of
cells of a level are the pairs of children of the level above whose centres are
not further apart than both radii and the threshold distance.  A cell that is so
small in radius that all its pairs link is cut no further; its links, and those of
two such cells that are near enough, are counted and not enumerated.

In each leaf (a block of one, if a cell could not be cut) a cover tree is built
once: nested levels of centres, radii halving from level to level, down to nodes
all of whose vectors link.  Leaves go in bins, in the order of the upper tree, and
a task meets two bins: of the pairs of leaves that remain, the pairs of nodes are
dropped by the same bound, after a product of their centres in single precision.
Nodes that link as a whole are counted; pairs of vectors of the nodes that are
left are verified by their cosine in double precision.  So a vector travels as
often as its label has bins, not leaves.

Equal vectors of a label are one node with a number of copies.  What leaves a
task is the number of links of each vector and a spanning forest of them.

Vectors link only within a label that is not null.  Vectors that are null, zero
or hold nulls or numbers that are not finite link with nothing, nor do vectors
of different lengths with each other.  Very large and very small numbers are
scaled by a power of two first.  Ids may be null or repeat; a component's
id is its smallest one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import discard, materialize, read, salt, salted_groups, salted_join, shuffle_partitions, sorted_groups
from rotaspark.llm.graph import components, forest

THRESHOLD = 0.98
#: Vectors of a leaf, centres a cell is cut by at most (about: they are chosen by hash), levels above the leaves.
CELL, PIVOTS, LEVELS = 1024, 64, 16
#: Vectors of a bin (about), centres of one that are met at once, pairs of vectors verified at once.
BIN, BATCH_CENTRES, BATCH_PAIRS = 32_768, 8192, 50_000
#: Slack of a cosine in single precision, which only rules out.
ROUGH = 1e-5
#: Slack of the metric bounds for rounding; the verification decides.
SLACK = 1e-6


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision."""
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Levels of nodes: centre (row), parent (node of the level above), covering radius; the last level holds the rows."""

    def __init__(self, points: np.ndarray, least: float = 1e-3):
        """Radii are halved as long as they are above `least`."""
        n = len(points)
        self.points = points
        from_root = distances(points, points[:1])[:, 0]
        radius = float(from_root.max())
        self.levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([radius]))]
        member = np.zeros(n, np.int64)  # of each row, its node in the last level
        while radius > least and len(self.levels[-1][0]) < n and len(self.levels) < 12:
            radius /= 2
            centres, parents, node = [], [], np.empty(n, np.int64)
            groups = np.split(np.argsort(member, kind="stable"), np.cumsum(np.bincount(member, minlength=len(self.levels[-1][0])))[:-1])
            for k, (top, rows) in enumerate(zip(self.levels[-1][0], groups)):
                if len(rows) == 1:
                    node[rows] = len(centres)
                    centres.append(top)
                    parents.append(k)
                    continue
                held = points[rows]
                best = distances(held, points[[top]])[:, 0]
                mine = np.full(len(rows), len(centres))
                centres.append(top)  # nested: a centre stays one
                parents.append(k)
                while (far := np.flatnonzero(best > radius)).size:
                    d = distances(held, held[far[:1]])[:, 0]
                    closer = d < best
                    mine[closer], best[closer] = len(centres), d[closer]
                    centres.append(rows[far[0]])
                    parents.append(k)
                node[rows] = mine
            member = node
            centres = np.array(centres)
            cover = np.zeros(len(centres))
            apart = np.sqrt(np.maximum(0, 2 - 2 * (points * points[centres[member]]).sum(1)))
            np.maximum.at(cover, member, apart)
            self.levels.append((centres, np.array(parents), cover))
        self.levels.append((np.arange(n), member, np.zeros(n)))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level k; beyond the last one, the rows again, each its own parent."""
        if k < len(self.levels):
            return self.levels[k]
        n = len(self.points)
        return np.arange(n), np.arange(n), np.zeros(n)


def close_pairs(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b with a cosine of at least the threshold."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    open_pairs = np.ones((1, 1), bool)
    for k in range(max(len(a.levels), len(b.levels))):
        (ca, pa_, ra), (cb, pb, rb) = a.level(k), b.level(k)
        if k:
            open_pairs = open_pairs[pa_][:, pb]
        rows, columns = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
        if not len(rows) or not len(columns):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = distances(a.points[ca[rows]], b.points[cb[columns]]) <= reach + ra[rows, None] + rb[columns]
        kept = np.zeros_like(open_pairs)
        kept[np.ix_(rows, columns)] = near
        open_pairs &= kept
    i, j = np.nonzero(open_pairs)
    found = [(a.points[i[at : at + 50_000]] * b.points[j[at : at + 50_000]]).sum(1) >= threshold for at in range(0, len(i), 50_000)]
    good = np.concatenate(found) if found else np.empty(0, bool)
    return i[good], j[good]


def vector_nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, node (null if it can link with nothing), raw: the vector's doubles, or floats if these are as exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, raws = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = None
                if label is not None and values and None not in values:
                    v = np.array(values, np.float64)
                    if np.isfinite(v).all() and v.any():
                        raw = _raw(np.ldexp(v, -np.frexp(np.abs(v).max())[1]) + 0.0)
                raws.append(raw)
                node.append(None if raw is None else xxhash.xxh3_64_intdigest(raw + str(label).encode()) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "label", "node", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, label string, node long, raw binary")


def _raw(v: np.ndarray) -> bytes:
    """The bytes of doubles, or where nothing is lost those of floats and one more: an odd number."""
    short = v.astype(np.float32)
    return short.tobytes() + b"f" if (short == v).all() else v.tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], np.float32).astype(np.float64) if len(raw) % 2 else np.frombuffer(raw)


def _width(raw: Column | str) -> Column:
    """Components of a raw vector."""
    n = F.length(raw)
    return F.when(n % 2 == 1, F.floor(n / 4)).otherwise(F.floor(n / 8))


def _points(raws: list[bytes]) -> np.ndarray:
    return unit(np.array([_vector(r) for r in raws]))


def _reach(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cell, salt, node, copies, raw, pivots), a group's pivots before its vectors: the vectors with the cell of the nearest pivot and the distance to it."""
    import xxhash

    key, top, points, names = None, [], np.empty((0, 0)), []
    for batch in batches:
        cells_, salts = (batch.column(k).to_numpy() for k in (0, 1))
        new = np.append(True, (cells_[1:] != cells_[:-1]) | (salts[1:] != salts[:-1])) if len(cells_) else np.empty(0, bool)
        begins = np.flatnonzero(new).tolist()
        for low, high in zip(begins, [*begins[1:], len(cells_)]):
            part, here = batch.slice(low, high - low), (int(cells_[low]), int(salts[low]))
            if here != key:
                key, top = here, part.column(5)[0].as_py()
                points, names = _points(top), [xxhash.xxh3_64_intdigest(here[0].to_bytes(8, "little", signed=True) + t) - 2**63 for t in top]
                part = part.slice(1)
            if part.num_rows:
                d = distances(_points(part.column(4).to_pylist()), points)
                near = d.argmin(1).tolist()
                columns = [part.column(0), pa.array([names[k] for k in near], pa.int64()), *[part.column(k) for k in (2, 3, 4)], pa.array(d.min(1)), pa.array([top[k] for k in near], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["parent", "cell", "node", "copies", "raw", "apart", "centre"])


def _moved(vectors: DataFrame, pivots: DataFrame, n: int) -> DataFrame:
    """Vectors (cell, node, copies, raw) to the nearest of their cell's pivots (cell, pivots), which travel once for each cell and salt."""
    salted = vectors.select("cell", salt(n, "node").alias("salt"), "node", "copies", "raw", F.lit(None).cast("array<binary>").alias("pivots"))
    wanted = salted.select("cell", "salt").distinct().join(pivots, "cell")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("node", "long"), ("copies", "long"), ("raw", "binary"))]
    rows = salted.unionByName(wanted.select("cell", "salt", *none, "pivots")).repartition(n, "cell", "salt")
    return rows.sortWithinPartitions("cell", "salt", F.asc_nulls_first("node")).mapInArrow(_nearest, PLACED)


PLACED = "parent long, cell long, node long, copies long, raw binary, apart double, centre binary"


def _summary(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("size"), F.sum("copies").alias("copies"), F.max("apart").alias("radius"), F.first("centre").alias("centre"), F.min("node").alias("least"))


def _named(cell: str) -> Column:
    return F.lpad(F.hex(cell), 16, "0")


def cells(nodes: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves of the upper tree: (nodes with their cell, cells, pairs of cells that may hold links).

    A root is a space: a label and a length of vectors.  Of each cell its space, and its path from there.
    nodes, a written table, goes once its vectors are placed.
    """
    reach = _reach(threshold)
    dense = (reach - SLACK) / 2
    roots = nodes.select(F.xxhash64("label", _width("raw")).alias("cell"), "node", "copies", "raw")
    first = roots.groupBy("cell").agg(F.min_by("raw", "node").alias("centre"))
    placed = materialize(_moved(roots, first.select("cell", F.array("centre").alias("pivots")), n), "cover-cells")
    discard(nodes)
    found = materialize(_summary(placed).withColumns({"space": F.col("parent"), "path": _named("cell")}), "cover-summary")
    pairs = materialize(found.select(F.col("cell").alias("a"), F.col("cell").alias("b")), "cover-pairs")
    for level in range(LEVELS):
        large = found.filter((F.col("size") > CELL) & (F.col("radius") > dense))
        if not large.head(1):
            break
        # About `wanted` vectors of each large cell, those with the smallest hashes, and its centre.
        wanted = F.least(F.lit(PIVOTS), 2 * F.ceil(F.col("size") / CELL))
        cut = salted_join(placed.select("cell", "node", "copies", "raw"), large.select("cell", "size", "centre"), ["cell"], "node", n)
        chosen = cut.filter(F.pmod(F.xxhash64("node", F.lit(level)), F.col("size")) < wanted).select("cell", "raw").unionByName(large.select("cell", F.col("centre").alias("raw")))
        pivots = chosen.distinct().groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("raw")), 1, 4 * PIVOTS).alias("pivots"))
        moved = _moved(cut, pivots, n)
        stay = placed.join(large.select("cell"), "cell", "left_anti").withColumn("parent", F.col("cell")).select(*moved.columns)
        following = materialize(moved.unionByName(stay), "cover-cells")
        discard(placed)
        placed = following
        above = found.select(F.col("cell").alias("parent"), "space", F.col("path").alias("above"))
        below = materialize(_summary(placed).join(above, "parent").withColumn("path", F.concat("above", _named("cell"))).drop("above"), "cover-summary")
        discard(found)
        found = below
        kids = found.groupBy("parent").agg(F.collect_list(F.struct("cell", "centre", "radius")).alias("kids"))  # at most 4 * PIVOTS
        both = pairs.join(kids.select(F.col("parent").alias("a"), F.col("kids").alias("left")), "a").join(kids.select(F.col("parent").alias("b"), F.col("kids").alias("right")), "b")
        below = materialize(both.select("a", "b", "left", "right").mapInArrow(_descend(reach + SLACK), "a long, b long"), "cover-pairs")
        discard(pairs)
        pairs = below
    return placed, found, pairs


def _descend(reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pair of cells, the pairs of their children that the covering radii do not rule out."""
        for batch in batches:
            for a, b, left, right in zip(*[c.to_pylist() for c in batch.columns]):
                near = distances(_points([k["centre"] for k in left]), _points([k["centre"] for k in right]))
                near = near <= reach + np.array([k["radius"] for k in left])[:, None] + np.array([k["radius"] for k in right])
                i, j = np.nonzero(near)
                one, two = np.array([k["cell"] for k in left])[i], np.array([k["cell"] for k in right])[j]
                if a == b:
                    one, two = one[one <= two], two[one <= two]
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return run


def _dealt(placed: DataFrame, found: DataFrame, open_pairs: DataFrame, reach: float, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of two bins and the pairs of their leaves that are to be met, by pair of bins; the tables written on the way.

    pair, side (0 and 1 for the bins, 2 for a bin that meets itself), leaf, fine (node of the leaf's tree), centre, node, copies, raw;
    and as side 3 the pairs of leaves, (leaf, node).
    """
    # A window over the leaves of a space: a row for some hundreds of its vectors.
    before = Window.partitionBy("space").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    leaves = found.select("cell", "space", "path", "size", blocks.alias("blocks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bin_ = F.floor(F.coalesce(F.sum(F.col("size") / F.col("blocks")).over(before), F.lit(0)) / BIN)
    leaves = materialize(leaves.select("cell", "block", F.xxhash64("cell", "block").alias("leaf"), F.xxhash64("space", bin_).alias("bin")), "cover-leaves")

    both = open_pairs.select("a", "b", "blocks_a", "blocks_b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1))).filter("a <> b or i <= j")
    for end, block in (("a", "i"), ("b", "j")):
        both = both.join(leaves.select(F.col("cell").alias(end), F.col("block").alias(block), F.col("leaf").alias(f"leaf_{end}"), F.col("bin").alias(f"bin_{end}")), [end, block])
    turned = F.col("bin_a") > F.col("bin_b")
    ends = [F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("leaf", "bin") for x, y in (("a", "b"), ("b", "a"))]
    both = materialize(both.select(*ends).withColumn("pair", F.xxhash64("bin_a", "bin_b")), "cover-open")

    bins = both.select("pair", "bin_a", "bin_b").distinct()
    same = F.col("bin_a") == F.col("bin_b")
    wanted = bins.select(F.col("bin_a").alias("bin"), "pair", F.when(same, 2).otherwise(0).alias("side")).unionByName(bins.filter(~same).select(F.col("bin_b").alias("bin"), "pair", F.lit(1).alias("side")))

    kept = both.select(F.col("leaf_a").alias("leaf")).unionByName(both.select(F.col("leaf_b").alias("leaf"))).distinct().withColumn("kept", F.lit(True))
    of_cell = leaves.join(kept, "leaf", "left").groupBy("cell").agg(F.max("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("block", "kept", "leaf", "bin"))).alias("leaves")).filter("kept").drop("kept")
    blocked = salted_join(placed.select("cell", "node", "copies", "raw"), of_cell, ["cell"], "node", n)
    blocked = blocked.withColumn("at", F.col("leaves")[F.pmod(F.xxhash64("node", F.lit(5)), F.size("leaves")).cast("int")]).filter("at.kept")
    blocked = blocked.select("at.leaf", "at.bin", "node", "copies", "raw").repartition(n, "leaf").sortWithinPartitions("leaf")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, 1):
            tree = CoverTree(_points(group["raw"].to_pylist()), (reach - SLACK) / 2)
            centre = np.zeros(group.num_rows, bool)
            centre[tree.levels[-2][0]] = True
            group = group.combine_chunks().append_column("fine", pa.array(tree.levels[-1][1].astype(np.int32))).append_column("centre", pa.array(centre))
            yield from group.to_batches()

    rows = blocked.mapInArrow(fine, "leaf long, bin long, node long, copies long, raw binary, fine int, centre boolean")
    # A row for each bin and bin it meets: few, for tens of thousands of vectors each.
    rows = rows.join(F.broadcast(wanted), "bin").select("pair", "side", "leaf", "fine", "centre", "node", "copies", "raw")
    met = both.select("pair", F.lit(3).alias("side"), F.col("leaf_a").alias("leaf"), F.lit(0).alias("fine"), F.lit(False).alias("centre"), F.col("leaf_b").alias("node"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("binary").alias("raw"))
    return rows.unionByName(met).repartition(n, "pair").sortWithinPartitions("pair", "side", "leaf", "fine"), [leaves, both]


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Leaves:
    """The leaves of a bin: its rows by leaf and node, the nodes' centres, radii and copies."""

    def __init__(self, rows: pa.Table, first: int):
        leaf, fine, self.copies = (rows[c].to_numpy() for c in ("leaf", "fine", "copies"))
        self.first, self.points = first, _points(rows["raw"].to_pylist())
        self.at = _begins(leaf, fine)
        self.sizes = np.diff(np.append(self.at, len(leaf)))
        self.centres = self.points[rows["centre"].to_numpy()]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.points * np.repeat(self.centres, self.sizes, 0)).sum(1)))
        self.radius = np.maximum.reduceat(apart, self.at)
        self.total = np.add.reduceat(self.copies, self.at)
        self.rough = self.centres.astype(np.float32)
        #: Leaves and their first nodes; the leaf of each node.
        self.heads = _begins(leaf[self.at])
        self.names = leaf[self.at][self.heads]
        self.heads = np.append(self.heads, len(self.at))
        self.leaf = np.repeat(np.arange(len(self.names)), np.diff(self.heads))
        #: Links that all vectors of a node have; whether they link with each other.
        self.more, self.own = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), bool)

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some nodes, and for each the first row of its node; numbered as in the task."""
        sizes = self.sizes[nodes]
        head = np.repeat(self.at[nodes], sizes)
        return self.first + head + np.arange(len(head)) - np.repeat(np.cumsum(sizes) - sizes, sizes), self.first + head


def _near_nodes(a: Leaves, b: Leaves, left: np.ndarray, right: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of the leaves left of a and right of b that may hold links, and how far apart their centres are."""
    order = np.argsort(left, kind="stable")
    left, right = np.searchsorted(a.names, left[order]), np.searchsorted(b.names, right[order])
    heads = _begins(left)
    for begin, end in zip(heads, np.append(heads[1:], len(left))):
        first, last = a.heads[left[begin]], a.heads[left[begin] + 1]
        to = np.sort(right[begin:end])
        nodes = np.concatenate([np.arange(b.heads[k], b.heads[k + 1]) for k in to])
        for at in range(0, len(nodes), BATCH_CENTRES):
            some = nodes[at : at + BATCH_CENTRES]
            far = reach + SLACK + a.radius[first:last].max() + b.radius[some].max()
            hits = np.flatnonzero((a.rough[first:last] @ b.rough[some].T).ravel() >= 1 - far * far / 2 - ROUGH)
            for k in range(0, len(hits), BATCH_PAIRS):
                i, j = np.divmod(hits[k : k + BATCH_PAIRS], len(some))
                i, j = first + i, some[j]
                if a is b:  # a leaf meets itself: each pair once
                    once = (a.leaf[i] != a.leaf[j]) | (i <= j)
                    i, j = i[once], j[once]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (a.centres[i] * b.centres[j]).sum(1)))
                if a is b:
                    apart[i == j] = 0
                near = apart <= reach + SLACK + a.radius[i] + b.radius[j]
                yield i[near], j[near], apart[near]


def _verified(a: Leaves, b: Leaves, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) of the pairs of nodes with a cosine of at least the threshold; of a node with itself each pair once."""
    ends = np.cumsum(a.sizes[i] * b.sizes[j])
    for at in range(0, int(ends[-1]) if len(ends) else 0, BATCH_PAIRS):
        flat = np.arange(at, min(int(ends[-1]), at + BATCH_PAIRS))
        k = np.searchsorted(ends, flat, "right")
        inside = flat - (ends[k] - a.sizes[i[k]] * b.sizes[j[k]])
        one, two = a.at[i[k]] + inside // b.sizes[j[k]], b.at[j[k]] + inside % b.sizes[j[k]]
        if a is b:
            once = (i[k] != j[k]) | (one < two)
            one, two = one[once], two[once]
        good = (a.points[one] * b.points[two]).sum(1) >= threshold
        yield one[good], two[good]


def _met(group: pa.Table, threshold: float) -> pa.RecordBatch:
    """Of two bins: the links of each vector (kind 0), and links that span what is linked (kind 1)."""
    side = group["side"].to_numpy()
    ends = np.searchsorted(side, [0, 1, 2, 3, 4]).tolist()
    parts = [group.slice(x, y - x) for x, y in zip(ends, ends[1:])]
    a = Leaves(parts[2] if parts[2].num_rows else parts[0], 0)
    b = a if parts[2].num_rows else Leaves(parts[1], len(a.copies))
    n = ends[3]
    node, links, root = group["node"].to_numpy()[:n], np.zeros(n, np.int64), np.arange(n)
    reach = _reach(threshold)
    inside = reach - SLACK

    def join(one: np.ndarray, two: np.ndarray) -> None:
        nonlocal root
        one, two = root[one], root[two]
        new = one != two
        if new.any():
            root = forest(n, one[new], two[new])[root]

    for i, j, apart in _near_nodes(a, b, parts[3]["leaf"].to_numpy(), parts[3]["node"].to_numpy(), reach):
        # Nodes all of whose vectors link, with each other and with those of the other node.
        whole = (2 * a.radius[i] <= inside) & (2 * b.radius[j] <= inside) & (apart + a.radius[i] + b.radius[j] <= inside)
        own = whole & (i == j) if a is b else np.zeros(len(i), bool)
        a.own[i[own]] = True
        join(*a.rows(i[own]))
        other = whole & ~own
        np.add.at(a.more, i[other], b.total[j[other]])
        np.add.at(b.more, j[other], a.total[i[other]])
        join(a.first + a.at[i[other]], b.first + b.at[j[other]])
        for one, two in _verified(a, b, i[~whole], j[~whole], threshold):
            np.add.at(links, a.first + one, b.copies[two])
            np.add.at(links, b.first + two, a.copies[one])
            join(a.first + one, b.first + two)
    for part in (a,) if a is b else (a, b):
        here = slice(part.first, part.first + len(part.copies))
        own = np.repeat(part.own, part.sizes)
        links[here] += np.repeat(part.more + part.own * part.total, part.sizes) - own * part.copies
    linked, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(links)
    kind = np.repeat([0, 1], [len(some), len(linked)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([node[some], node[linked]])), pa.array(np.concatenate([links[some], node[root[linked]]]))], ["kind", "a", "b"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    n = shuffle_partitions(vectors.sparkSession)
    rows = materialize(vector_nodes(vectors, id_col, vector_col, label_col), "cover-rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.min("raw").alias("raw"))
    distinct = materialize(nodes, "cover-distinct")
    # From here on a vector's numbers are only where it is placed.
    narrow = materialize(rows.select("vec_id", "node"), "cover-ids")
    discard(rows)
    nodes = materialize(distinct.select("node", "first_id", "copies"), "cover-nodes")
    placed, found, pairs = cells(distinct, threshold, n)

    # Pairs of cells all of whose vectors link (a cell with itself among them) are counted; the others are traversed.
    inside = _reach(threshold) - SLACK
    side = lambda s: found.select(F.col("cell").alias(s), F.struct("copies", "radius", "centre", "least", F.ceil(F.col("size") / CELL).cast("int").alias("blocks")).alias(f"of_{s}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_points(batch.column(k).field("centre").to_pylist()) if batch.num_rows else np.empty((0, 1)) for k in (2, 3))
            radius = sum(batch.column(k).field("radius").to_numpy(zero_copy_only=False) for k in (2, 3))
            same = batch.column(0).to_numpy() == batch.column(1).to_numpy()
            apart = np.where(same, 0, np.sqrt(np.maximum(0, 2 - 2 * (one * two).sum(1))))
            values = [batch.column(k).field(c) for c in ("copies", "least", "blocks") for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values, pa.array(apart + radius <= inside)], ["a", "b", "copies_a", "copies_b", "least_a", "least_b", "blocks_a", "blocks_b", "whole"])

    measures = materialize(known.mapInArrow(_by_length(measured), "a long, b long, copies_a long, copies_b long, least_a long, least_b long, blocks_a int, blocks_b int, whole boolean"), "cover-known")
    whole = measures.filter("whole")
    own = F.col("a") == F.col("b")
    more = whole.select(F.col("a").alias("cell"), F.col("copies_b").alias("more"), F.col("least_b").alias("hub"), own.alias("own"))
    more = more.unionByName(whole.filter(~own).select(F.col("b").alias("cell"), F.col("copies_a").alias("more"), F.col("least_a").alias("hub"), F.lit(False).alias("own")))
    # All vectors of a cell link to the hub: one of its own, if these all link, else one of a partner's.
    hub = F.coalesce(F.max(F.when(F.col("own"), F.col("hub"))), F.min("hub"))
    more = more.groupBy("cell").agg(F.sum("more").alias("more"), hub.alias("hub"), F.max("own").alias("own"))
    counted = salted_join(placed.select("cell", "node", "copies"), more, ["cell"], "node", n)
    # Of a cell whose vectors all link, `more` holds the vector itself.
    counted = materialize(counted.select("node", "hub", F.when(F.col("own"), F.col("more") - F.col("copies")).otherwise(F.col("more")).alias("more")), "cover-counted")
    joined = counted.filter("hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(whole.filter(~own).select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))

    dealt, listed = _dealt(placed, found, measures.filter("not whole"), _reach(threshold), n)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, 1):
            yield _met(group, threshold)

    traversed = materialize(dealt.mapInArrow(traverse, "kind int, a long, b long"), "cover-links")
    classes = components(traversed.filter("kind = 1").select("a", "b").unionByName(joined))
    links = traversed.filter("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("more")).unionByName(counted.select("node", "more")).groupBy("node").agg(F.sum("more").alias("links"))
    known = nodes.select("node", "first_id", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = salted_groups(known, ["component"], "first_id", n, "min")
    known = materialize(known.select("node", F.col("group_keep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "cover-classes")
    for used in (nodes, placed, found, pairs, measures, *listed, counted, traversed, classes):
        discard(used)
    linked = salted_join(narrow.filter("node is not null"), known, ["node"], "vec_id", n).select("vec_id", "n_links", "component_id")
    alone = narrow.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _by_length(run):
    """run over parts of the batches whose vectors have one length."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(c) for c in batch.column(2).field("centre").to_pylist()], np.int64)
            for size in np.unique(sizes):
                yield batch.take(pa.array(np.flatnonzero(sizes == size)))

    return lambda batches: run(parts(batches))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {THRESHOLD}),
reach AS (SELECT vec_id AS m, vec_id FROM embeddings UNION SELECT r.m, p.b FROM reach r JOIN pairs p ON p.a = r.vec_id),
least AS (SELECT vec_id, min(m) AS component_id FROM reach GROUP BY 1),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN links USING (vec_id)
"""
