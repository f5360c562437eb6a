"""Lloyd's centroids with two trees: a cover tree over each block of vectors, kept from round to round, and a tree over the
centroids, made anew each round.

Blocks are made where the vectors are read, without a shuffle, and written with their trees: for each node the range of
its vectors, its centre, its covering radius, and the exact sum of its vectors. In a round the trees are walked together:
a node of centroids goes when its distance, less both radii, is beyond the nearest centroid's, and a node of vectors that
a single centroid is left for is assigned as a whole, by its sum. Leaves are compared exactly, in integers. A task sends
sums for each centroid, so a round moves as many rows as tasks times centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .cover_tree import SLACK, CoverTree

#: Vectors of a block, points in a leaf, and the largest size of a whole component: beyond it components are cut to it,
#: so that every squared distance is a long.
BLOCK, LEAF, LARGEST = 512, 24, 1 << 27


def whole_components(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components floor(scale * x)) of the vectors with exactly ``dims`` components, all of them finite."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = np.isfinite(x).all(1)
    return rows[finite], np.clip(np.floor(scale * x[finite]), -LARGEST, LARGEST).astype(np.int64)


class Block:
    """Vectors with their cover tree as arrays: a node's vectors are ``rows[low:high]``, its children follow it."""

    FIELDS = {"ids": np.int64, "points": np.int32, "low": np.int32, "high": np.int32, "parent": np.int32, "centre": np.int32, "radius": np.float64, "sums": np.int64}

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> Block:
        tree = CoverTree(points.astype(np.float64), np.arange(len(ids)), len(ids), LEAF)
        parent = np.full(len(tree.centre), -1)
        for k, children in enumerate(tree.children):
            parent[children] = k
        # leaves in the order of a walk from the root; a node's vectors are those of its leaves, next to each other
        order, low, high, at, stack = [], np.zeros(len(parent), int), np.zeros(len(parent), int), 0, [(0, False)]
        while stack:
            k, seen = stack.pop()
            if seen:
                high[k] = at
                continue
            low[k] = at
            stack.append((k, True))
            if tree.children[k]:
                stack += [(c, False) for c in tree.children[k]]
            else:
                order.append(tree.rows[k])
                at += len(tree.rows[k])
        order = np.concatenate(order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
        self = cls()
        self.ids, self.points, self.low, self.high, self.parent = ids[order], points[order], low, high, parent
        self.centre, self.radius, self.sums = place[np.array(tree.centre)], np.array(tree.radius), total[high] - total[low]
        return self

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS.items()]

    @classmethod
    def unpacked(cls, fields: list[bytes], dims: int) -> Block:
        self = cls()
        for (name, kind), raw in zip(cls.FIELDS.items(), fields):
            setattr(self, name, np.frombuffer(raw, kind).astype(np.int64 if kind != np.float64 else kind))
        self.points, self.sums = self.points.reshape(-1, dims), self.sums.reshape(-1, dims)
        self.children = [np.flatnonzero(self.parent == k) for k in range(len(self.parent))]
        return self


class DualAssignment:
    """Each vector of a block to its nearest centroid (ties: the smaller number): ``totals`` by centroid, and with
    ``labels`` the centroid and the squared distance of each vector."""

    def __init__(self, block: Block, centroids: np.ndarray, labels: bool) -> None:
        self.block, self.centroids = block, centroids
        self.tree = CoverTree(centroids.astype(np.float64), np.arange(len(centroids)), len(centroids), 1)
        self.counts, self.totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        self.compared = 0
        self.label = np.zeros(len(block.ids), np.int64) if labels else None
        self._walk()
        if labels:
            self.distance = ((block.points - centroids[self.label]) ** 2).sum(1)

    def _assign(self, node: int, centroid: int) -> None:
        low, high = self.block.low[node], self.block.high[node]
        self.counts[centroid] += high - low
        self.totals[centroid] += self.block.sums[node]
        if self.label is not None:
            self.label[low:high] = centroid

    def _walk(self) -> None:
        b, t = self.block, self.tree
        at, radius = t.points[np.array(t.centre)], np.array(t.radius)
        stack = [(0, np.array([0]))]
        while stack:
            node, found = stack.pop()
            centre, reach = b.points[b.centre[node]], b.radius[node]
            while True:
                far = np.sqrt(((at[found] - centre) ** 2).sum(1))
                limit = (far.min() + reach) * (1 + SLACK) + SLACK
                found, far = found[far - reach - radius[found] <= limit], far[far - reach - radius[found] <= limit]
                wide = found[radius[found] >= max(reach, 1e-300)] if len(b.children[node]) else found[radius[found] > 0]
                if not len(wide):  # the vectors' node is the wider one, or only leaves are left
                    break
                found = np.concatenate([found[~np.isin(found, wide)], *[t.children[k] for k in wide.tolist()]]).astype(np.int64)
            own = [t.rows[k] for k in found.tolist()]
            if len(own) == 1 and len(own[0]) == 1:
                self._assign(node, int(own[0][0]))
            elif len(b.children[node]):
                stack += [(int(c), found) for c in b.children[node]]
            else:
                self._compare(node, np.sort(np.concatenate(own)))

    def _compare(self, node: int, among: np.ndarray) -> None:
        low, high = self.block.low[node], self.block.high[node]
        points = self.block.points[low:high]
        self.compared += len(points) * len(among)
        distance = ((points[:, None, :] - self.centroids[among][None, :, :]) ** 2).sum(2)
        best = among[distance.argmin(1)]
        np.add.at(self.counts, best, 1)
        np.add.at(self.totals, best, points)
        if self.label is not None:
            self.label[low:high] = best


def _blocks(table: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """A row for each block, where its vectors were read."""
    form = ", ".join(f"{name} binary" for name in Block.FIELDS)

    def made(ids: list[np.ndarray], points: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Block.build(np.concatenate(ids), np.concatenate(points)).packed()], list(Block.FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            rows, x = whole_components(batch.column(1), dims, scale)
            own, a = batch.column(0).to_numpy(zero_copy_only=False)[rows], 0
            while a < len(own):
                b = min(len(own), a + BLOCK - held)
                ids, points, held, a = [*ids, own[a:b]], [*points, x[a:b]], held + b - a, b
                if held == BLOCK:
                    yield made(ids, points)
                    ids, points, held = [], [], 0
        if held:
            yield made(ids, points)

    return table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, form)


def _first(table: DataFrame, count: int, seed: int, dims: int, scale: float, id_col: str, vector_col: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; equal hashes by the vectors."""
    v = F.col(vector_col).cast("array<double>")
    kept = table.where(F.col(id_col).isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("long").cast("string")), 256)
    rows = kept.select(v.alias("v")).orderBy(h, v).limit(count).toArrow()  # as many as centroids
    return whole_components(rows["v"], dims, scale)[1]


def centroid_clusters(table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` rounds.

    Components are floor(scale * x); distances are squared and exact, ties go to the smaller number, and a centroid
    becomes the componentwise floor of its vectors' mean, or stays where it has none. Vectors that are null, have not
    exactly ``dims`` components or hold a null or non-finite one, and rows with a null id, are left out. Equal rows count
    each; fewer vectors than ``k`` give as many centroids. Components beyond 2**27 count as 2**27, and sums of distances
    beyond a long as the largest long. An empty table gives no rows.
    """
    spark = table.sparkSession
    centroids = _first(table, k, seed, dims, scale, id_col, vector_col)
    names = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, {names}")
    blocks = materialise(_blocks(table, dims, scale, id_col, vector_col), "blocks")

    def opened(batch: pa.RecordBatch) -> Iterator[Block]:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield Block.unpacked(list(row), dims)

    for _ in range(rounds):
        now = centroids

        def summed(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                for block in opened(batch):
                    found = DualAssignment(block, now, False)
                    counts, totals = counts + found.counts, totals + found.totals
            number = np.repeat(np.arange(len(now)), dims + 1)
            part = np.tile(np.arange(-1, dims), len(now))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, part, np.c_[counts, totals].ravel())], ["cluster", "part", "n"])

        sums = blocks.mapInArrow(summed, "cluster long, part long, n long").groupBy("cluster", "part").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        found = {(r["cluster"], r["part"]): int(r["n"]) for r in sums.collect()}  # centroids times components
        centroids = now.copy()
        for c in range(len(now)):
            if n := found.get((c, -1), 0):
                centroids[c] = [found[c, d] // n for d in range(dims)]
        if (centroids == now).all():
            break  # no later round changes anything

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in opened(batch):
                found = DualAssignment(block, centroids, True)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(found.label.astype(np.int32)), pa.array(found.distance)], [id_col, "cluster", "distance"])

    out = materialise(blocks.mapInArrow(labelled, f"{id_col} long, cluster int, distance long"), "labels")
    release(blocks)
    largest = (1 << 63) - 1
    total = {r["cluster"]: int(r["n"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    told = [(c, min(n, largest), min(sum(total.values()), largest), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in total.items()]
    of = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row a centroid
    return out.join(of, "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
