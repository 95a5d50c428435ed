"""Connected components of an edge table: union-find.

Tasks of at most ``EDGES`` edges contract them with union-find, so only a forest leaves each.
If there is one such task, that is the answer; else large-star and small-star rounds (alternating, each a grouped minimum and a join) then merge the forests of
all tasks until every node points at the smallest node of its component. Rounds are written to
the shared folder. No component is ever gathered in one place: a component that holds a third of
all nodes is a star whose edges spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import stage


#: Edges that a task contracts.
EDGES = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its set) for all nodes but the smallest of each set."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(flat[:len(u)].tolist(), flat[len(u):].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as a forest."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        u, v = union_find(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _mark(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs to (node, root): every node that isn't the smallest of its component,
    with the smallest. Loops and repeated edges are allowed."""
    edges = edges.select("u", "v").where("u <> v")
    tasks = -(-edges.count() // EDGES)
    e = stage(edges.repartition(max(1, tasks)).mapInArrow(_contract, "u long, v long"), "forest")
    if tasks <= 1:                          # one task's forest is whole
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = e.distinct()
    seen = _mark(e)
    while True:
        # Large star: a node sends its larger neighbours to its smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(
            "u <> v").distinct()
        # Small star: a node sends its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = stage(small, "stars")
        now = _mark(new)
        e = new
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
