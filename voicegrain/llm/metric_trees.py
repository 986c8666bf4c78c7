"""Centroid clustering with ball trees: whole balls of vectors go to a centroid where the triangle inequality allows no other.

Vectors become integers, and each task builds balanced ball trees over BLOCK of its vectors at a time: a node has the middle, radius, count
and integer sum of its vectors, and its two halves lie on either side of the median along the line between two far vectors. The trees are written once and
read in every round. A centroid is out of the running for a ball if it is further from the middle than the nearest one is, by more than twice
the radius; where one is left, the ball's count and sum go to it, else the halves are looked at, down to leaves of LEAF
vectors, whose distances are exact integers. Each task sends one count and one sum for each centroid.

Cases: null vectors, those of another length, and those with a null or non-finite component are not kept; an empty table, or one without kept
vectors, gives an empty result; fewer vectors than centroids make as many centroids as there are; equal vectors chosen as centroids share
theirs by the smaller number; repeated rows each count; a null vec_id is chosen last. Integers beyond RANGE are an error, since
their distances would not be exact in doubles. Only vec_id and embedding are read, so that clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

CLUSTERS, ROUNDS, SCALE, SIZE = 16, 3, 64, 64
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 2_048, 32
#: Integers of at most this size have squared distances below 2^53, up to 128 components.
RANGE = 1 << 22
#: What distances in doubles may be off by, relative to their size.
SLACK = 1e-9
TREES = "ids array<long>, points binary, sums binary, counts binary, radii binary"


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors of `size` components that are all there and finite."""
    x = F.col("embedding")
    whole = (F.size(x) == size) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    floored = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    far = F.exists("v", lambda c: F.abs(c) > RANGE)
    kept = vectors.where(x.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("v"))
    return kept.withColumn("v", F.when(far, F.raise_error(F.lit(f"a component is beyond {RANGE}"))).otherwise(F.col("v")))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over points: their order, and by node (children of i: 2i + 1, 2i + 2) the integer sums, counts and radii.

    A level halves every run of the order; the last level's runs are the leaves.
    """
    n, depth = len(points), 0
    while n >> depth > LEAF:
        depth += 1
    order, runs, sums, counts, radii = np.arange(n), [(0, n)], [], [], []
    for level in range(depth + 1):
        halves = []
        for a, b in runs:
            own = points[order[a:b]]
            total = own.sum(axis=0)
            middle = total / (b - a)
            gap = ((own - middle) ** 2).sum(axis=1)
            sums.append(total)
            counts.append(b - a)
            radii.append(np.sqrt(gap.max()))
            if level < depth:
                one = own[gap.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - one).astype(np.float64), half)]
                halves += [(a, a + half), (a + half, b)]
        runs = halves
    return order, np.array(sums), np.array(counts), np.array(radii)


def trees(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """One row (TREES) for each BLOCK of a task's vectors (vec_id, v), in the order of the tree's leaves."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
            order, sums, counts, radii = build(flat)
            binary = [flat[order].astype(np.int32), sums, counts, radii]
            cells = [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in binary)]
            return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in TREES.split(", ")])

        ids, held = [], []
        for batch in batches:
            flat = batch["v"].flatten().to_numpy().reshape(-1, size)
            ids, held = [*ids, batch["vec_id"]], [*held, flat]
            if sum(len(h) for h in held) >= BLOCK:
                all_ids, flat = pa.concat_arrays(ids), np.concatenate(held)
                cut = len(flat) // BLOCK * BLOCK
                for a in range(0, cut, BLOCK):
                    yield row(all_ids[a : a + BLOCK], flat[a : a + BLOCK])
                ids, held = [all_ids[cut:]], [flat[cut:]]
        if sum(len(h) for h in held):
            yield row(pa.concat_arrays(ids), np.concatenate(held))

    return vectors.mapInArrow(grow, TREES)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in doubles; exact for integers within RANGE."""
    p, c = points.astype(np.float64), centroids.astype(np.float64)
    return (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]


class Tree:
    """A row of trees(), read back."""

    def __init__(self, points: bytes, sums: bytes, counts: bytes, radii: bytes, size: int) -> None:
        self.points = np.frombuffer(points, np.int32).reshape(-1, size)
        self.sums = np.frombuffer(sums, np.int64).reshape(-1, size)
        self.counts, self.radii = np.frombuffer(counts, np.int64), np.frombuffer(radii, np.float64)
        self.middles = self.sums / self.counts[:, None]

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """The nearest centroid of each point, the smaller number among equals; balls taken whole, as (node, centroid); which points are in none."""
        gap = np.sqrt(((self.middles[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
        least = gap.min(axis=1)
        near = gap <= (least + 2 * self.radii + SLACK * (1 + least + self.radii))[:, None]
        labels, taken = np.full(len(self.points), -1, np.int32), []
        stack = [(0, 0, len(labels), near[0])]
        while stack:
            node, a, b, running = stack.pop()
            left = np.flatnonzero(running)
            if len(left) == 1:
                labels[a:b] = left[0]
                taken.append((node, int(left[0])))
            elif 2 * node + 1 < len(self.counts):
                middle = a + (b - a) // 2
                stack += [(2 * node + 1, a, middle, running & near[2 * node + 1]), (2 * node + 2, middle, b, running & near[2 * node + 2])]
        loose = labels < 0
        labels[loose] = squared(self.points[loose], centroids).argmin(axis=1)
        return labels, taken, loose


def _forest(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, Tree(*(batch[c][i].as_buffer() for c in ("points", "sums", "counts", "radii")), size)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floored means of the vectors nearest to each; those without vectors stay."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)  # the sums, and the count
        for _, _, tree in _forest(batches, size):
            labels, taken, loose = tree.assign(centroids)
            for node, c in taken:
                total[c, :size] += tree.sums[node]
                total[c, size] += tree.counts[node]
            np.add.at(total, labels[loose], np.concatenate([tree.points[loose], np.ones((loose.sum(), 1), np.int64)], axis=1))
        cells = [np.repeat(np.arange(k), size + 1), np.tile(np.arange(size + 1), k), total.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], ["c", "dim", "n"])

    parts = forest.select("points", "sums", "counts", "radii").mapInArrow(add, "c long, dim long, n long")
    total = np.zeros((k, size + 1), np.int64)
    for r in parts.groupBy("c", "dim").agg(F.sum("n").alias("n")).collect():  # k * (size + 1) rows
        total[r["c"], r["dim"]] = r["n"]
    count = total[:, size:]
    return np.where(count > 0, total[:, :size] // np.maximum(count, 1), centroids)


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster (int), distance (long, squared) of every vector."""
    size = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, tree in _forest(batches, size):
            labels = tree.assign(centroids)[0]
            distance = ((tree.points.astype(np.int64) - centroids[labels]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(labels), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(label, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector. vectors: vec_id, embedding.

    The first centroids are the vectors with the least SHA-256 of `seed:vec_id`.
    """
    spark = vectors.sparkSession
    whole = integers(vectors, size, scale)
    first = whole.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    chosen = first.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    if not chosen:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in chosen], np.int64)
    forest = materialize(trees(whole, size), "trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    rows = materialize(assigned(forest, centroids), "assigned")
    spread = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each cluster
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [(c, n, sum(spread.values()), digest[c]) for c, n in spread.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    joined = rows.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
