"""Connected components: union-find inside each partition, then large-star and small-star rounds across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

ROUNDS = 200
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]] if len(nodes) else nodes


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the smallest node: the same components with no more edges."""
    for x in batches:
        if x.num_rows:
            node, label = union_find(x["a"].to_numpy(), x["b"].to_numpy())
            own = node != label
            yield pa.record_batch([pa.array(node[own]), pa.array(label[own])], schema=_EDGE)


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node, the smallest node among itself and its neighbours."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of ``edges`` (columns a, b, long): label is the smallest node reachable.

    Rounds end when a round changes nothing; their number grows with the logarithm of the number of nodes. Hot
    nodes are split by adaptive skew joins, as the joins stand alone in their stages.
    """
    now = edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    now = scratch.write(now, f"{name}-0")
    mark = None
    for turn in range(1, ROUNDS + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = scratch.write(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        seen = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
        now = after
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    # now every edge leads from a node to its label
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
