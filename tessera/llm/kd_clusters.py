"""Centroid clustering by filtering kd-trees.

Every task cuts its vectors into blocks and builds a kd-tree for each: a node holds the count, the integer sums and the
bounding box of its vectors. The trees are written once to the shared folder; a round only reads them. A tree is walked level
by level, all nodes of a level at once. Of the centroids that a node still considers, the one nearest to the box's middle
stands against the others: one that is farther even from the corner of the box that favours it most is strictly dominated and
pruned, so a tie is never decided by pruning. A node with one centroid left is assigned as a whole, by its count and sums; the
vectors of leaves are compared with the centroids left, exactly, and ties go to the smaller number. A round sends one row per
task and cluster, and k rows reach the driver.

All numbers are integers: floor(scale * x), and centroids floor(sum / count). So that squared distances fit in a long,
components are held to +-2^27, which vectors of |x| under 131,072 never reach. An inertia beyond a long is null.

Vectors with another number of components, a null vector, or a null or non-finite component are left out. Rows with a null or
a repeated vec_id are vectors like any other; as first centroids, null ids come last and equal ids go by their components.
Equal vectors, however many, form one leaf whose box is a point. With fewer vectors than k there are fewer centroids, and
an empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import forget, slices, written

#: Components are held to this range: 64 squares of a difference stay under 2^63.
MOST = 1 << 27
#: Vectors of one tree, and of a leaf.
BLOCK, LEAF = 16_384, 64
TREE = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("points", "nodes", "sums", "boxes"))])
TREE_COLUMNS = "ids array<long>, points binary, nodes binary, sums binary, boxes binary"


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the vector's integers; vectors that aren't complete are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    # a null component makes the test null, which counts as not passed
    whole = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    held = F.transform("x", lambda e: F.greatest(F.least(F.floor(F.greatest(F.least(e, F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == dims) & whole).select("vec_id", held.alias("v"))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, nodes (start, end, left child, or -1 for a leaf), sums, boxes (least and greatest) of a kd-tree.

    A node is cut at the median of its box's widest side; both children follow each other in the list of nodes.
    """
    order = np.arange(len(points))
    nodes, boxes = [[0, len(points), -1]], []
    at = 0
    while at < len(nodes):
        start, end, _ = nodes[at]
        own = points[order[start:end]]
        low, high = own.min(0), own.max(0)
        boxes.append((low, high))
        side = int(np.argmax(high.astype(np.int64) - low))
        if end - start > LEAF and high[side] > low[side]:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, side], middle)]
            nodes[at][2] = len(nodes)
            nodes += [[start, start + middle, -1], [start + middle, end, -1]]
        at += 1
    found = np.array(nodes, np.int64)
    running = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0, dtype=np.int64)])
    return order, found, running[found[:, 1]] - running[found[:, 0]], np.array(boxes, np.int32)


def trees(numbers: DataFrame, dims: int) -> DataFrame:
    """A row per tree, of at most BLOCK vectors of one task each."""

    def grow(batches):
        def tree(parts):
            ids, points = (np.concatenate(x) if k else pa.chunked_array(x).to_pylist() for k, x in enumerate(zip(*parts, strict=True)))
            order, nodes, sums, boxes = build(points)
            row = [[ids[i] for i in order], points[order].tobytes(), nodes.tobytes(), sums.tobytes(), boxes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TREE.types, strict=True)], schema=TREE)

        parts, held = [], 0
        for b in slices(batches, 1024):
            parts.append((b.column(0), b.column(1).flatten().to_numpy().reshape(-1, dims)))
            held += b.num_rows
            if held + 1024 > BLOCK:
                yield tree(parts)
                parts, held = [], 0
        if held:
            yield tree(parts)

    return numbers.mapInArrow(grow, TREE_COLUMNS)


class Tree:
    def __init__(self, row: dict, dims: int):
        self.ids = row["ids"]
        self.points = np.frombuffer(row["points"], np.int32).reshape(-1, dims)
        self.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
        self.boxes = np.frombuffer(row["boxes"], np.int32).reshape(-1, 2, dims)

    def assigned(self, centroids: np.ndarray):
        """(node, cluster) for nodes that are assigned whole; (places of vectors, clusters, squared distances) for the rest."""
        k = len(centroids)
        whole, rest = [(np.empty(0, np.int64),) * 2], [(np.empty(0, np.int64),) * 3]
        front, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(front):
            low, high = self.boxes[front, 0].astype(np.int64), self.boxes[front, 1].astype(np.int64)
            far = np.iinfo(np.int64).max
            # twice the middle against twice the centroid, so that all stays whole; the choice of the best only steers pruning
            middle = np.stack([((low + high - 2 * c).astype(np.float64) ** 2).sum(1) for c in centroids], 1)
            middle[~open_] = np.inf
            best = middle.argmin(1)
            top = centroids[best]
            for z, c in enumerate(centroids):
                corner = np.where(c > top, high, low)
                open_[:, z] &= ((corner - c) ** 2).sum(1) <= ((corner - top) ** 2).sum(1)
            single = open_.sum(1) == 1
            whole.append((front[single], open_[single].argmax(1)))
            leaf = ~single & (self.nodes[front, 2] < 0)
            if leaf.any():
                size = self.nodes[front[leaf], 1] - self.nodes[front[leaf], 0]
                of = np.repeat(np.arange(len(size)), size)
                places = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.nodes[front[leaf], 0], size)
                own, allowed = self.points[places].astype(np.int64), open_[leaf][of]
                distance = np.stack([((own - c) ** 2).sum(1) for c in centroids], 1)
                distance[~allowed] = far
                cluster = distance.argmin(1)  # the first of equals
                rest.append((places, cluster, distance[np.arange(len(of)), cluster]))
            down = ~single & ~leaf
            left = self.nodes[front[down], 2]
            front, open_ = np.concatenate([left, left + 1]), np.concatenate([open_[down]] * 2)
        return tuple(np.concatenate(x) for x in zip(*whole, strict=True)), tuple(np.concatenate(x) for x in zip(*rest, strict=True))


def _each_tree(batches, dims: int):
    for b in batches:
        for i in range(b.num_rows):
            yield Tree({c: b.column(c)[i].as_py() for c in b.schema.names}, dims)


def summed(grown: DataFrame, centroids: np.ndarray) -> list:
    """Count and sums of each non-empty cluster: at most k rows."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def add(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for tree in _each_tree(batches, dims):
            (nodes, of), (places, own, _) = tree.assigned(centroids)
            np.add.at(n, of, tree.nodes[nodes, 1] - tree.nodes[nodes, 0])
            np.add.at(s, of, tree.sums[nodes])
            n += np.bincount(own, minlength=k)
            for z in range(k):
                s[z] += tree.points[places[own == z]].sum(0, dtype=np.int64)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(n[has]), pa.array([s[z] for z in has], schema.types[2])], schema=schema)

    per_task = grown.mapInArrow(add, "cluster int, n long, s array<long>")
    return per_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(dims))).alias("s")).collect()


def distances(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def measure(batches):
        for tree in _each_tree(batches, dims):
            (nodes, of), (places, own, far) = tree.assigned(centroids)
            cluster, distance = np.empty(len(tree.points), np.int32), np.empty(len(tree.points), np.int64)
            cluster[places], distance[places] = own, far
            for node, z in zip(nodes, of, strict=True):
                start, end, _ = tree.nodes[node]
                cluster[start:end] = z
                distance[start:end] = ((tree.points[start:end].astype(np.int64) - centroids[z]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster), pa.array(distance)], schema=schema)

    return grown.mapInArrow(measure, "vec_id long, cluster int, distance long")


def first_centroids(numbers: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hash of seed and id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = numbers.withColumn("_mark", mark).orderBy(F.col("_mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per complete vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    vectors: vec_id and embedding, an array of numbers. Reads the vectors twice (first centroids, trees) and the trees once
    a round.
    """
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, dims, scale)
    centroids = first_centroids(numbers, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    grown = written(trees(numbers, dims))
    for _ in range(rounds):
        moved = centroids.copy()
        for r in summed(grown, centroids):
            moved[r.cluster] = [int(s) // r.n for s in r.s]
        if (moved == centroids).all():
            break  # later rounds would change nothing
        centroids = moved
    found = written(distances(grown, centroids))
    forget(grown)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    as_long = lambda n: n if n < 1 << 63 else None
    # k rows at most: as columns by cluster, so that nothing is joined
    by_cluster = lambda f, kind: F.element_at(F.array(*(F.lit(f(z)).cast(kind) for z in range(len(centroids)))), F.col("cluster") + 1)
    digest = lambda z: hashlib.sha256(",".join(map(str, centroids[z].tolist())).encode()).hexdigest()
    return found.select("vec_id", "cluster", "distance", by_cluster(lambda z: as_long(inertia.get(z, 0)), "long").alias("cluster_inertia"), F.lit(as_long(sum(inertia.values()))).cast("long").alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"))
