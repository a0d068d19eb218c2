"""Exact top-k search by inner product with an M-tree.

Vectors become integer vectors. An extra coordinate sqrt(M - |x|^2), with M
the largest squared norm, puts all candidates at one distance from the
origin; then d(q, x)^2 = |q|^2 + M - 2 <q, x>, the nearest candidate has the
highest score, and the Euclidean metric holds for a tree.

The tree's upper part is grown on Spark, a level at a time: a cell of more
than SUBTREE_ROWS rows gets routing vectors (up to CELL_FANOUT of its distinct
rows, as many as it needs) and its rows go to the nearest one, slice by slice,
so a cell's number of rows bounds no task. The number of cells grows with the
rows; entries (routing vector, covering radius, distance to the parent) are
a table. Cells of equal rows, and those still too large after LEVELS levels,
are dealt by hash into parts. Queries go down the same levels by joins with the
entries: an entry is passed over, with no distance computed, when
|d(q, parent) - d(entry, parent)| exceeds its radius and what the query may
still reach.

A task takes one part of a cell and at most about QUERY_CHUNK of the queries
that arrive there. It builds the part as an M-tree of paged nodes, and the
queries stream past. A query visits nodes best first, by the least distance any
of a node's rows can have; entries are passed over as above, with the distance
of the k-th best so far, and so is a row of a page, by its stored parent
distance.

A query starts with the k-th best score among the sample, which every tree
must beat. Pruning allows for rounding (SLACK); scores are exact integers.

Defined cases: vectors that are null, empty or of another length than the
most frequent one (of equally frequent ones, the longest), or hold null or
non-finite components, and rows without vec_id, take no part; rows of one
vec_id are one vector's repeats and are no candidates of each other, and query
rows of one vec_id have one answer between them; equal scores go to the smaller
vec_id; scores beyond the range of a long become its ends; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trickle.llm.common import stage

SAMPLE = 4096
CELL_FANOUT = 64
LEVELS = 8
SUBTREE_ROWS = 16_384
QUERY_CHUNK = 4096
PAGE = 2048
FANOUT = 16
SLACK = 1e-6
LONG = 2**63 - 1


class Space:
    """The metric space: integer vectors with their extra coordinate."""

    def __init__(self, largest: float) -> None:
        self.largest = largest
        # inner products are exact in doubles below 2^53
        self.exact = largest < 2**52

    def lift(self, rows: np.ndarray) -> np.ndarray:
        """Candidates with the extra coordinate."""
        rest = np.maximum(0.0, self.largest - (rows * rows).sum(axis=1))
        return np.hstack([rows, np.sqrt(rest)[:, None]])

    @staticmethod
    def query(rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.zeros((len(rows), 1))])

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products; of Python integers where doubles would round."""
        if self.exact:
            return rows @ q
        whole = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in rows], object)

    def reach(self, q: np.ndarray, score) -> float:
        """Distance within which rows have ``score`` or more."""
        if score is None:
            return math.inf
        square = float((q * q).sum()) + self.largest - 2 * float(score)
        return math.sqrt(max(0.0, square)) * (1 + SLACK) + SLACK * (1 + math.sqrt(self.largest))


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


class Node:
    """Entries of a node. A leaf is a page of rows by distance to the routing
    vector; an inner node holds child nodes."""

    __slots__ = ("center", "radius", "parent_distance", "children", "child_far", "child_radius", "rows", "far", "start")

    def __init__(self, center: np.ndarray) -> None:
        self.center = center
        self.radius = 0.0
        self.parent_distance = 0.0
        self.children: list[Node] = []
        self.rows: np.ndarray | None = None
        self.far = self.child_far = self.child_radius = None
        self.start = 0

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def build(points: np.ndarray, members: np.ndarray, center: np.ndarray) -> Node:
    """Bulk-load a subtree over ``members`` (row numbers of ``points``)."""
    node = Node(center)
    far = distances(points[members], center)
    node.radius = float(far.max(initial=0.0))
    if len(members) <= PAGE:
        order = np.argsort(far, kind="stable")
        node.rows, node.far = members[order], far[order]
        return node
    # routing vectors: far apart from each other, starting with the farthest
    chosen = [int(np.argmax(far))]
    nearest = distances(points[members], points[members[chosen[0]]])
    owner = np.zeros(len(members), np.int64)
    fan = min(FANOUT, -(-2 * len(members) // PAGE))
    while len(chosen) < fan and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        d = distances(points[members], points[members[chosen[-1]]])
        closer = d < nearest
        owner[closer] = len(chosen) - 1
        nearest = np.minimum(nearest, d)
    if len(chosen) == 1:  # equal rows: pages by place
        owner = np.arange(len(members)) * min(FANOUT, -(-len(members) // PAGE)) // len(members)
    for o in np.unique(owner):
        part = members[owner == o]
        route = points[members[chosen[o]]] if len(chosen) > 1 else points[part[0]]
        child = build(points, part, route)
        child.parent_distance = float(distances(route[None], center)[0])
        node.children.append(child)
    node.child_far = np.array([c.parent_distance for c in node.children])
    node.child_radius = np.array([c.radius for c in node.children])
    return node


class Tree:
    def __init__(self, space: Space, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.space, self.ids, self.rows = space, ids[order], rows[order]
        points = space.lift(self.rows)
        self.root = build(points, np.arange(len(ids)), points.mean(axis=0))
        # rows stand as their pages do, so that a page is a slice
        pages = [n for n in self.root.walk() if n.rows is not None]
        starts = np.cumsum([0, *(len(p.rows) for p in pages)])
        order = np.concatenate([p.rows for p in pages])
        self.ids, self.rows = self.ids[order], self.rows[order]
        for page, start in zip(pages, starts.tolist()):
            page.start = start

    def search(self, q_id: int, q: np.ndarray, k: int, floor) -> list[tuple[int, int]]:
        """Best (score, vec_id) of the tree's rows that reach ``floor``, at
        most k, ties to the smaller id."""
        space = self.space
        lifted = np.append(q, 0.0)
        best: list[tuple] = []  # heap of (score, -id)
        reach = space.reach(q, floor)
        d = float(distances(self.root.center[None], lifted)[0])
        queue = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        pushed = 0
        while queue:
            low, _, d, node = heapq.heappop(queue)
            if low > reach:
                break
            if node.children:
                # by stored distances first, then by computed ones
                hope = np.abs(d - node.child_far) - node.child_radius <= reach
                for child in (c for c, h in zip(node.children, hope) if h):
                    dc = float(np.sqrt(((child.center - lifted) ** 2).sum()))
                    if dc - child.radius <= reach:
                        pushed += 1
                        heapq.heappush(queue, (max(0.0, dc - child.radius), pushed, dc, child))
                continue
            a = np.searchsorted(node.far, d - reach, "left")
            b = np.searchsorted(node.far, d + reach, "right")
            if a == b:
                continue
            a, b = node.start + int(a), node.start + int(b)
            score = space.scores(self.rows[a:b], q)
            least = best[0][0] if len(best) == k else floor
            good = np.arange(b - a) if least is None else np.flatnonzero(score >= least)
            for g in good.tolist():
                row_id = int(self.ids[a + g])
                if row_id == q_id:
                    continue
                entry = (int(score[g]), -row_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                reach = min(reach, space.reach(q, best[0][0]))
        return [(s, -i) for s, i in best]


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )

    def whole(c: Column) -> Column:
        # floor() of a double gives a long; larger components are whole as they are
        y = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(y) >= 2.0**62, y).otherwise(F.floor(y).cast("double"))

    return table.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v")
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lifted(v: Column, largest: float) -> Column:
    rest = F.lit(largest) - F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)
    return F.concat(v, F.array(F.sqrt(F.greatest(F.lit(0.0), rest))))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, c: s + c))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal ``keys`` within each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in keys]
        turns = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            turns |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(turns) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield tuple(c[a] for c in cols), b.slice(a, z - a)


def _split(placed: DataFrame, level: int, space: Space, width: int) -> tuple[DataFrame, DataFrame] | None:
    """One level of the tree's upper part: the rows of cells that are too large
    (vec_id, v, row, node, far), each in the child whose routing vector is
    nearest, and the children's entries (parent, node, center). None if no cell
    can be split."""
    cells = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    large = cells.where((F.col("n") > SUBTREE_ROWS) & (F.col("radius") > 0))
    # routing vectors: of some hundred distinct rows of the cell, the first by hash
    drawn = (
        placed.join(large.select("node", "n"), "node")
        .where(F.pmod(F.xxhash64("vec_id", "v", F.lit(level)), F.col("n")) < 4 * CELL_FANOUT)
        .select("node", "n", "v").distinct()
    )
    by_hash = Window.partitionBy("node").orderBy(F.xxhash64("v"), "v")
    fan = F.least(F.lit(CELL_FANOUT), F.ceil(F.col("n") * 2 / F.lit(SUBTREE_ROWS)))
    routing = drawn.withColumn("at", F.row_number().over(by_hash) - 1).where(F.col("at") < fan)
    routing = stage(routing.withColumn("slices", F.ceil(F.col("n") / F.lit(SUBTREE_ROWS))), "routing")
    split = routing.where("at = 1").select("node", "slices")
    if split.isEmpty():
        return None
    # every slice of a cell's rows meets the cell's routing vectors
    none = F.lit(None).cast("long")
    centers = routing.join(split.select("node"), "node", "left_semi").select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
        "at", none.alias("vec_id"), "v", none.alias("row"),
    )
    rows = placed.join(split, "node").select(
        "node", F.pmod(F.xxhash64("row"), "slices").alias("slice"), F.lit(CELL_FANOUT).alias("at"), "vec_id", "v", "row"
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points = None, []
        for key, b in _groups(batches, ["node", "slice"]):
            if key != now:
                now, points = key, []
            at = b.column("at").to_numpy()
            lifted = space.lift(_matrix(b.column("v"), width))
            first = int(np.searchsorted(at, CELL_FANOUT))
            points.extend(lifted[:first])
            if first == len(at):
                continue
            d = np.stack([distances(lifted[first:], p) for p in points], axis=1)
            own = d.argmin(axis=1)
            child = int(key[0]) * CELL_FANOUT + 1 + own
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).slice(first) for c in ("vec_id", "v", "row")], pa.array(child), pa.array(d.min(axis=1))],
                ["vec_id", "v", "row", "node", "far"],
            )

    met = centers.unionAll(rows).repartition("node", "slice").sortWithinPartitions("node", "slice", "at")
    below = stage(met.mapInArrow(assign, "vec_id long, v array<double>, row long, node long, far double"), "placed")
    entries = routing.join(split.select("node"), "node", "left_semi").select(
        F.col("node").alias("parent"), (F.col("node") * CELL_FANOUT + 1 + F.col("at")).alias("node"),
        _lifted(F.col("v"), space.largest).alias("center"),
    )
    return below, entries


def top_k(table: DataFrame, every: int, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each
    row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    # all rows start in the root, at no known distance (written, so that joins on the node are by key)
    vectors = stage(
        integer_vectors(table, scale).select(
            "*", F.monotonically_increasing_id().alias("row"),
            F.lit(0).cast("long").alias("node"), F.lit(math.inf).alias("far"),
        ), "vectors",
    )
    lengths = vectors.groupBy(F.size("v").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], empty)
    width = most["size"]
    vectors = vectors.where(F.size("v") == width)
    head = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    space = Space(float(vectors.agg(F.max(norm)).first()[0]))
    sample_ids = np.array([r.vec_id for r in head], np.int64)
    sample = np.array([r.v for r in head], np.float64)
    shared = spark.sparkContext.broadcast((sample_ids, sample))
    root = space.lift(sample[:1])[0]

    # the upper part, a level at a time: cells, and the entries of their children
    placed = vectors
    parents = spark.createDataFrame([(0, root.tolist())], "node long, center array<double>")
    leaves, levels = [], []
    for level in range(LEVELS):
        below = _split(placed, level, space, width)
        if below is None:
            break
        rows, entries = below
        radii = rows.groupBy("node").agg(F.max("far").alias("radius"))
        above = parents.select(F.col("node").alias("parent"), F.col("center").alias("_above"))
        entries = stage(
            entries.join(radii, "node").join(above, "parent")
            .select("parent", "node", "center", "radius", _distance(F.col("center"), F.col("_above")).alias("far")),
            "entries",
        )
        leaves.append(placed.join(entries.select(F.col("parent").alias("node")), "node", "left_anti"))
        levels.append(entries)
        placed, parents = rows, entries.select("node", "center")
    leaves.append(placed)
    below = leaves[0].select("node", "vec_id", "v", "row")
    for more in leaves[1:]:
        below = below.unionAll(more.select("node", "vec_id", "v", "row"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the score and the distance that the sample assures."""
        sample_ids, sample = shared.value
        for b in batches:
            ids, q = b.column("vec_id").to_numpy(), _matrix(b.column("v"), width)
            least, reach = [], []
            for i in range(len(ids)):
                score = space.scores(sample, q[i])[sample_ids != ids[i]]
                floor = np.sort(score)[-k] if len(score) >= k else None
                least.append(None if floor is None else str(int(floor)))  # exact, of any size
                reach.append(space.reach(q[i], floor))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"), b.column("v"), pa.array(least, pa.string()), pa.array(reach, pa.float64()),
                    pa.array(np.zeros(len(ids), np.int64)), pa.array(distances(space.query(q), root)),
                ],
                ["vec_id", "v", "least", "reach", "node", "d"],
            )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances to children; those stay whose rows may be near enough."""
        for b in batches:
            q = space.query(_matrix(b.column("v"), width))
            d = np.sqrt(((q - _matrix(b.column("center"), width + 1)) ** 2).sum(axis=1))
            near = pa.array(d - b.column("radius").to_numpy() <= b.column("reach").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).filter(near) for c in ("vec_id", "v", "least", "reach", "node")], pa.array(d).filter(near)],
                ["vec_id", "v", "least", "reach", "node", "d"],
            )

    form = "vec_id long, v array<double>, least string, reach double, node long, d double"
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    at = stage(queries.mapInArrow(start, form), "queries")
    arrived = []
    for entries in levels:
        arrived.append(at.join(entries.select(F.col("parent").alias("node")), "node", "left_anti"))
        e = entries.withColumnsRenamed({"node": "child", "far": "parent_far"})
        # passed over by stored distances, without a new one
        hopeful = at.join(e, at.node == e.parent).where(F.abs(F.col("d") - F.col("parent_far")) - F.col("radius") <= F.col("reach"))
        at = stage(
            hopeful.select("vec_id", "v", "least", "reach", F.col("child").alias("node"), "center", "radius")
            .mapInArrow(visit, form), "queries",
        )
    arrived.append(at)
    pairs = arrived[0].select("node", "vec_id", "v", "least")
    for more in arrived[1:]:
        pairs = pairs.unionAll(more.select("node", "vec_id", "v", "least"))

    # a task takes one part of a cell's rows and one chunk of its queries
    size = below.groupBy("node").agg(F.ceil(F.count("*") / F.lit(SUBTREE_ROWS)).alias("parts"))
    load = pairs.groupBy("node").agg(F.ceil(F.count("*") / F.lit(QUERY_CHUNK)).alias("chunks"))
    tasks = stage(size.join(load, "node"), "tasks")
    zero = F.lit(0).cast("long")
    rows = below.join(tasks, "node").select(
        "node", F.pmod(F.xxhash64("row"), "parts").alias("part"),
        F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"),
        F.lit(0).alias("side"), "vec_id", "v", F.lit(None).cast("string").alias("least"),
    )
    asked = pairs.join(tasks, "node").select(
        "node", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("vec_id", "v"), "chunks").alias("chunk"), F.lit(1).alias("side"), "vec_id", "v", "least",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a subtree come first, then its queries."""
        now, ids, rows, tree = None, [], [], None
        for (*key, side), b in _groups(batches, ["node", "part", "chunk", "side"]):
            if key != now:
                now, ids, rows, tree = key, [], [], None
            vec_id, v = b.column("vec_id").to_numpy(), _matrix(b.column("v"), width)
            if side == 0:
                ids.append(vec_id)
                rows.append(v)
                continue
            if tree is None:
                if not ids:
                    continue
                tree = Tree(space, np.concatenate(ids), np.concatenate(rows))
                ids, rows = [True], []
            out: list[tuple[int, int, int]] = []
            for i, least in enumerate(b.column("least").to_pylist()):
                for score, found in tree.search(int(vec_id[i]), v[i], k, None if least is None else int(least)):
                    out.append((int(vec_id[i]), found, max(-LONG - 1, min(LONG, score))))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"]
            )

    task = ["node", "part", "chunk"]
    met = rows.unionAll(asked).repartition(*task).sortWithinPartitions(*task, "side")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
