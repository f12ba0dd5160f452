"""Exact search for the highest inner products: ball-tree branch and bound in each shard.

Vectors are dealt to shards of bounded size; each shard's ball tree is built once and written. For a query q, no vector in
a ball of centre c and radius r scores above q.c + |q| r; nodes are visited in order of that bound, until it falls below
the query's k-th best score so far. That score is shared: a first pass finds it for each query in the shard whose root has
the highest bound, and then the query goes to those other shards only whose root's bound reaches it. A task reads a
shard's tree, and the queries after it as a stream; so a tree moves once in each pass, and a query once for each shard
that may hold a result. No pair is emitted but the results.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch, bounded_batches

SHARD, LEAF = 16_384, 64
#: numbers of all shards' roots that may be broadcast (8 bytes each); beyond it, queries go to every shard and are cut off at its root.
ROOTS = 4_000_000
_NO_BOUND, _MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Balls over integer vectors; the vectors of a node lie together."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left child, right child
        centres, radii = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            own = vectors[self.order[first:end]].astype(np.float64)
            centre = own.mean(0)
            centres.append(centre)
            radii.append(math.sqrt(((own - centre) ** 2).sum(1).max()))
            self.nodes.append((first, end, -1, -1))
            at = len(self.nodes) - 1
            if parent >= 0:
                f, e, a, b = self.nodes[parent]
                self.nodes[parent] = (f, e, at if side == 0 else a, at if side == 1 else b)
            if end - first > leaf:
                # along the line through two far points
                a = own[((own - centre) ** 2).sum(1).argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                along = own @ (b - a)
                half = (end - first) // 2
                self.order[first:end] = self.order[first:end][np.argpartition(along, half)]
                todo += [(first, first + half, at, 0), (first + half, end, at, 1)]
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return upper(self.centre, self.radius, queries)

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, at_least: int, bound: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best, ties to the smaller id, without the row ``own`` and those below ``at_least``."""
        bound = self.bounds(query[None])[0] if bound is None else bound
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            floor = max(at_least, best[0][0]) if len(best) == k else at_least
            if -top < floor:
                break
            first, end, a, b = self.nodes[node]
            if a >= 0:
                for x in (a, b):
                    if bound[x] >= floor:
                        heapq.heappush(queue, (-bound[x], x))
                continue
            score = self.vectors[first:end] @ query
            if score.dtype == object:  # a score beyond a long counts as the nearest
                score = np.array([min(max(int(x), _NO_BOUND), _MOST) for x in score], np.int64)
            for i in np.flatnonzero(score >= floor).tolist():
                key = int(ids[self.order[first + i]])
                if key != own:
                    entry = (int(score[i]), -key)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def upper(centre: np.ndarray, radius: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of each query and ball: what no inner product exceeds. The slack covers rounding, so that no exact tie is cut off."""
    q = queries.astype(np.float64)
    along = q @ centre.T
    norm = np.sqrt((q**2).sum(1))[:, None]
    most = along + radius[None] * norm * (1 + 1e-9) + 1e-6 * (1 + np.abs(along)) + 1e-9 * norm * np.sqrt((centre**2).sum(1))[None]
    return np.maximum(most, float(_NO_BOUND))  # as scores do, bounds end where longs do


def _matrix(rows: list[list[int]], other: int = 0) -> np.ndarray:
    """As 64-bit integers, or as Python's where an inner product with numbers of up to ``other`` might not fit."""
    top = max((abs(x) for r in rows for x in r), default=0)
    fits = top * max(top, other) * max(1, len(rows[0])) < 1 << 61
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), -1)


def _built(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
    """A shard's tree, as one row; and its root, for the choice of shards."""
    tree = BallTree(_matrix(shard["v"].to_pylist()))
    packed = pickle.dumps((tree, shard["vec_id"].to_numpy()), protocol=5)
    root = [*tree.centre[0].tolist(), float(tree.radius[0])]
    columns = (([key[0].as_py()], pa.int32()), ([key[1].as_py()], pa.int64()), ([packed], pa.binary()), ([root], pa.list_(pa.float64())))
    return pa.table([pa.array(x, t) for x, t in columns], ["dim", "shard", "tree", "root"])


def _routed(roots, first_pass: bool):
    """Queries with the shards that they go to: the one of the highest bound, or all others whose bound reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = roots.value
        for batch in batches:
            rows, shards = [], []
            dims = batch["dim"].to_numpy()
            floor = batch["floor"].to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                number, centre, radius = known[dim]
                bound = upper(centre, radius, np.array([batch["v"][int(i)].as_py() for i in at], np.float64).reshape(len(at), -1))
                home = bound.argmax(1)
                for j, i in enumerate(at.tolist()):
                    to = home[j : j + 1] if first_pass else np.flatnonzero(bound[j] >= floor[i])
                    to = to if first_pass else to[to != home[j]]
                    rows += [i] * len(to)
                    shards += number[to].tolist()
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([out["vec_id"], out["v"], out["dim"], out["floor"], pa.array(shards, pa.int64())], ["vec_id", "v", "dim", "floor", "shard"])

    return run


def _searched(k: int):
    """Results of queries that come after the tree of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, top = None, None, 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            trees, at = batch["tree"], 0
            for i in [*np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                part = batch.slice(at, i - at)
                if part.num_rows and tree is not None:
                    asked = _matrix(part["v"].to_pylist(), top)
                    bounds = tree.bounds(asked)
                    for own, q, floor, bound in zip(part["vec_id"].to_pylist(), asked, part["floor"].to_pylist(), bounds, strict=True):
                        out += [(own, x, s) for s, x in tree.search(q, k, ids, own, floor, bound)]
                if i < batch.num_rows:
                    tree, ids = pickle.loads(trees[i].as_py())
                    top = int(max(abs(int(tree.vectors.min())), abs(int(tree.vectors.max())))) if tree.vectors.size else 0
                at = i + 1
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, shard: int = SHARD, roots: int = ROOTS) -> DataFrame:
    """The k highest inner products of each query with all vectors (vec_id long, v array<long>), but the query's own row.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all, if there are fewer than k.
    Vectors meet only vectors of their own length; rows that are null or hold nulls must have been left out. A
    vec_id names one row: copies of a row that share it are taken as one. A score beyond a long counts as the nearest
    long. Other columns are ignored. Empty tables give an empty one.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ball-tree")
    # copies would take the places of others among the k best
    vectors = vectors.select("vec_id", "v").dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    vectors = scratch.write(vectors, "vectors")
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = {dim: -(-n // shard) for dim, n in sizes.items()}
    parts = F.lit(1)
    for dim, n in shards.items():  # one entry for each length of vector
        parts = F.when(F.col("dim") == dim, F.lit(n)).otherwise(parts)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), parts))
    trees = dealt.groupBy("dim", "shard").applyInArrow(_built, "dim int, shard long, tree binary, root array<double>")
    trees = scratch.write(trees, "trees")

    asked = queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    asked = scratch.write(asked.join(F.broadcast(trees.select("dim").distinct()), "dim", "left_semi"), "asked")
    floors = asked.withColumn("floor", F.lit(_NO_BOUND).cast("long"))
    by_root = sum(n * (dim + 1) for dim, n in shards.items()) <= roots
    if by_root:
        known: dict[int, list] = {}
        for r in trees.select("dim", "shard", "root").collect():
            known.setdefault(r["dim"], []).append((r["shard"], r["root"]))
        balls = {d: (np.array([x for x, _ in rs]), np.array([r[:-1] for _, r in rs], np.float64).reshape(len(rs), -1), np.array([r[-1] for _, r in rs])) for d, rs in known.items()}
        shared = spark.sparkContext.broadcast(balls)

    columns = "vec_id long, v array<long>, dim int, floor long, shard long"

    def search(routed: DataFrame) -> DataFrame:
        stream = trees.drop("root").unionByName(routed, allowMissingColumns=True)
        stream = stream.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull())
        return stream.select("tree", "vec_id", "v", "floor").mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    def route(rows: DataFrame, first_pass: bool) -> DataFrame:
        if by_root:
            return rows.mapInArrow(_routed(shared, first_pass), columns)
        home = F.pmod(F.xxhash64("vec_id"), parts)
        if first_pass:
            return rows.withColumn("shard", home)
        return rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).where(F.col("shard") != home)

    first = scratch.write(search(route(floors, True)), "first")
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n = {k}")
    again = asked.join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    again = again.select("vec_id", "v", "dim", F.coalesce("least", F.lit(_NO_BOUND).cast("long")).alias("floor"))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = first.unionByName(search(route(again, False))).withColumn("rank", ranked).where(f"rank <= {k}")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component; without rows that are null or hold null, NaN or infinity."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("v"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
