"""Connected components of an undirected graph given by edges: contraction in partitions, then alternating stars."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable

#: Edges that one task contracts; a graph with more spans several and goes on in rounds.
EDGES_PER_TASK = 500_000


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges (i, j) tie it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches):
    """The edges of a partition as stars around the least node of each of its components."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = least_reached(len(nodes), at[: len(u)], at[len(u) :])
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; root is the smallest node reachable. Edges are rows (u, v) of longs.

    Each task contracts up to EDGES_PER_TASK edges to stars, which settles a small graph. What several
    tasks hold goes on in rounds of large and small stars: each ties neighbours to the least node around,
    in joins on the node that Spark may split where a node is hot, until every node points at a root.
    Edges never leave the executors.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")))
    tasks = math.ceil(now.count() / EDGES_PER_TASK)
    now = durable(now.coalesce(max(tasks, 1)).mapInArrow(_contract, "u long, v long"))
    while tasks > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = durable(tied.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        several = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if several.isEmpty() and now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
