"""Exact top-k search by inner product with two cover trees.

Vectors lie in cells around a few pivots, and within a cell in blocks of bounded size. A bounded sample of vectors gives
each query a first k-th best score. A query goes only to the cells whose ball (around the pivot, and around zero) allows
a score as good. Queries of a cell go in parts of bounded size, so that no task holds more than a block and a part,
however many queries there are. In each block its vectors and a part of the queries are held as cover trees and walked
together: a pair of nodes is left out when the centres and covering radii show that no vector below one can reach the
worst k-th score of the queries below the other.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Pivots at most, and vectors in the sample that gives first scores (those with the smallest hash of the id; every
#: vector is indexed and compared or left out by a bound).
PIVOTS, SAMPLE = 256, 2_048
#: Vectors of a block.
BLOCK = 2_048
#: Points in a leaf, and the factor by which radii shrink from level to level.
LEAF, SHRINK = 192, 1.3
SLACK = 1e-9


class CoverTree:
    """A cover tree over the rows of ``points``: each node's centre is one of its points.

    A node's children are chosen greedily: a point that no chosen centre covers within the smaller radius becomes one, so
    that centres lie apart by more than that radius and cover all points below.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, most_equal: int, leaf: int = LEAF) -> None:
        self.points, self.ids, self.leaf = points, ids, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.root = self._node(np.arange(len(ids)), None, most_equal) if len(ids) else -1
        self.norm = np.sqrt((points**2).sum(1))

    def _node(self, rows: np.ndarray, distance: np.ndarray | None, most_equal: int) -> int:
        pending = [(rows, distance, -1)]
        while pending:
            rows, distance, parent = pending.pop()
            if distance is None:
                distance = self._distance(rows, rows[0])
            node, radius = len(self.centre), float(distance.max())
            centre = int(rows[distance.argmin()])
            if radius == 0 and len(rows) > most_equal:  # equal points: only the smallest ids can be among the best
                rows = rows[np.argsort(self.ids[rows], kind="stable")[:most_equal]]
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if radius == 0 or len(rows) <= self.leaf:
                continue
            limit, left, own = radius / SHRINK, rows, distance
            near = own <= limit
            while len(left):
                pending.append((left[near], own[near], node))
                left = left[~near]
                if len(left):
                    own = self._distance(left, left[0])
                    near = own <= limit
        return 0

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(1))


class DualSearch:
    """The best ``k`` vectors of each query, by score and then by smaller id."""

    def __init__(self, queries: CoverTree, vectors: CoverTree, k: int, known: np.ndarray) -> None:
        self.q, self.v, self.k = queries, vectors, k
        n = len(queries.ids)
        self.known = known  # a k-th score that each query has elsewhere
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        largest = max(np.abs(queries.points).max(initial=0) * np.abs(vectors.points).max(initial=0) * max(queries.points.shape[1], 1), 1.0)
        self.whole = largest < 2**53  # then floating-point products are exact integers
        self.slack = SLACK * largest
        if n and len(vectors.ids):
            self._walk()

    def _bound(self, a: int, b: int) -> float:
        q, v = self.q, self.v
        ca, cb = q.centre[a], v.centre[b]
        return float(q.points[ca] @ v.points[cb]) + v.radius[b] * q.norm[ca] + q.radius[a] * v.norm[cb] + q.radius[a] * v.radius[b]

    def _worst(self, a: int) -> float:
        rows = self.q.rows[a]
        return float(np.maximum(self.score[rows, -1], self.known[rows]).min())

    def _walk(self) -> None:
        heap = [(-self._bound(0, 0), 0, 0)]
        while heap:  # the most promising pair first
            bound, a, b = heapq.heappop(heap)
            if -bound + self.slack < self._worst(a):
                continue
            below_a, below_b = self.q.children[a], self.v.children[b]
            if not below_a and not below_b:
                self._compare(self.q.rows[a], self.v.rows[b])
            elif below_a and (not below_b or self.q.radius[a] >= self.v.radius[b]):
                for x in below_a:
                    heapq.heappush(heap, (-self._bound(x, b), x, b))
            else:
                for y in below_b:
                    heapq.heappush(heap, (-self._bound(a, y), a, y))

    def _compare(self, rows: np.ndarray, other: np.ndarray) -> None:
        a, b = self.q.points[rows], self.v.points[other]
        score = a @ b.T if self.whole else (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)
        score[self.q.ids[rows][:, None] == self.v.ids[other][None, :]] = -np.inf  # its own row
        worst = np.maximum(self.score[rows, -1], self.known[rows])
        r, c = np.nonzero((score >= worst[:, None]) & (score > -np.inf))
        if not len(r):
            return
        met, first = np.unique(r, return_index=True)
        # what is new and what each of these queries has had, in order; the first k of each query stay
        row = np.concatenate([r, np.repeat(met, self.k)])
        value = np.concatenate([score[r, c], self.score[rows[met]].ravel()])
        ids = np.concatenate([self.v.ids[other][c], self.id[rows[met]].ravel()])
        order = np.lexsort((ids, -value, row))
        size = np.diff(np.concatenate([first, [len(r)]])) + self.k
        best = order[(np.cumsum(size) - size)[:, None] + np.arange(self.k)]
        self.score[rows[met]], self.id[rows[met]] = value[best], ids[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector id, score) of all that may be among the best."""
        good = (self.score > -np.inf) & (self.score >= self.known[:, None])
        row, _ = np.nonzero(good)
        return row, self.id[good], self.score[good]


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    rows = [np.frombuffer(x, "<f8") for x in column.to_pylist()]
    width = max([len(r) for r in rows], default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : min(len(r), width)] = r[:width]
    return out


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, vector) with components floor(scale * x) as packed doubles. Vectors that are null or hold a null or
    non-finite component, and rows with a null id, are left out; equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else None
                if x is not None and np.isfinite(x).all():
                    ids.append(i)
                    out.append(np.floor(scale * x).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "vector"])

    plain = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "id long, vector binary").distinct()


def _best(own: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each vector among ``others`` with another id; -inf if there are fewer."""
    score = own @ others.T
    score[ids[:, None] == other_ids[None, :]] = -np.inf
    return np.partition(score, len(other_ids) - k, axis=1)[:, len(other_ids) - k] if len(other_ids) >= k else np.full(len(own), -np.inf)


def exact_top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest inner products, ties to the smaller id.

    Queries are the rows of ``table`` where ``is_query`` (a condition on the column ``id``) holds; candidates are all
    rows with another id. Fewer candidates give fewer ranks. Shorter vectors, empty ones too, count as if they ended in
    zeros. An id with several different vectors may come up once for each. An empty table, or one without queries, gives
    no rows. How many cells the bounds leave out depends on the data: vectors without clusters in many dimensions are
    compared with all queries, block by block.
    """
    spark = table.sparkSession
    vectors = materialise(whole_vectors(table, id_col, vector_col, scale), "vectors")
    n = vectors.count()
    h = F.xxhash64("id")
    few = vectors.where(F.pmod(h, F.lit(1 << 30)) < min(1.0, 4.0 * SAMPLE / max(n, 1)) * (1 << 30)).orderBy(h, "id", "vector").limit(SAMPLE).collect()  # at most SAMPLE rows
    width = vectors.agg(F.max(F.octet_length("vector"))).first()[0] or 0
    sample = _matrix(pa.chunked_array([pa.array([bytes(r["vector"]) for r in few], pa.binary())]), width // 8)
    pivots = sample[: min(PIVOTS, max(1, math.ceil(n / BLOCK)))]
    shared = spark.sparkContext.broadcast((sample, np.array([r["id"] for r in few], np.int64), pivots))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[2]
        for batch in batches:
            points = _matrix(batch.column(1), width // 8)
            cell = (points @ own.T - (own**2).sum(1) / 2).argmax(1) if len(points) else np.zeros(0, np.int64)
            far = np.sqrt(((points - own[cell]) ** 2).sum(1)) if len(points) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((points**2).sum(1)))], ["id", "vector", "cell", "far", "norm"])

    vectors = vectors.mapInArrow(placed, "id long, vector binary, cell int, far double, norm double")
    cells = [tuple(r) for r in vectors.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("norm")).collect()]  # a row a pivot
    blocks = {cell: math.ceil(size / BLOCK) for cell, size, _, _ in cells}
    balls = {cell: (far, norm) for cell, _, far, norm in cells}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, ids, own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                q = _matrix(part.column(1), width // 8)
                size = np.sqrt((q**2).sum(1))
                worst = _best(q, part.column(0).to_numpy(), points, ids, k)
                names = sorted(balls)
                far, norm = (np.array([balls[c][j] for c in names]) for j in (0, 1))
                bound = np.minimum(q @ own[names].T + size[:, None] * far, size[:, None] * norm)
                row, col = np.nonzero(bound * (1 + np.sign(bound) * SLACK) + SLACK * size[:, None] * norm >= worst[:, None])
                yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in part.columns] + [pa.array(np.array(names, np.int32)[col]), pa.array(worst[row])], ["id", "vector", "cell", "worst"])

    queries = materialise(vectors.where(is_query).select("id", "vector").mapInArrow(asked, "id long, vector binary, cell int, worst double"), "queries")
    if queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("cell"))
    indexed = vectors.select("id", "vector", "cell", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("block"))
    asking = {r["cell"]: math.ceil(r["count"] / BLOCK) for r in queries.groupBy("cell").count().collect()}  # a row a pivot
    sides = F.element_at(F.create_map(*[F.lit(x) for pair in asking.items() for x in pair]), F.col("cell"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), sides).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    indexed = indexed.where(F.col("cell").isin(list(asking))).withColumn("part", F.explode(F.sequence(F.lit(0), sides - 1)))

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        trees = [CoverTree(_matrix(t["vector"], width // 8), t["id"].to_numpy(), most) for t, most in ((asked, asked.num_rows), (block, k + 1))]
        row, other, score = DualSearch(*trees, k, asked["worst"].to_numpy().astype(np.float64)).found()
        name = pa.array([zlib.crc32(x) for x in asked["vector"].to_pylist()], pa.int64())
        return pa.table([asked["id"].take(pa.array(row)), name.take(pa.array(row)), pa.array(other, pa.int64()), pa.array(score, pa.float64())], ["id", "name", "other", "score"])

    met = queries.groupBy("cell", "block", "part").cogroup(indexed.groupBy("cell", "block", "part")).applyInArrow(meet, "id long, name long, other long, score double")
    order = F.row_number().over(Window.partitionBy("id", "name").orderBy(F.desc("score"), "other"))
    best = met.withColumn("rank", order).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), F.col("score").cast("long").alias("score"))
