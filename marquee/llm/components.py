"""Connected components by alternating stars; every round is two grouped joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import materialize


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the given edges' components."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    pairs = np.unique(flat[:len(u)].astype(np.int64) * len(nodes) + flat[len(u):]) if len(u) else flat
    above = list(range(len(nodes)))

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for pair in pairs.tolist():
        a, b = top(pair // len(nodes)), top(pair % len(nodes))
        if a != b:
            above[max(a, b)] = min(a, b)
    tops = np.array([top(x) for x in range(len(nodes))], np.int64)
    joined = tops != np.arange(len(nodes))
    return nodes[joined], nodes[tops[joined]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(*(batch.column(c).to_numpy() for c in ("u", "v")))
        yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v); the label is its component's smallest node.

    Edges are first contracted batch by batch, so a dense group travels as few rows. No
    node's neighbours are gathered: rounds use minima, which combine before the shuffle.
    """
    stars = materialize(edges.select("u", "v").mapInArrow(_contracted, "u long, v long").distinct(), "links")
    seen = None
    while True:
        # large star: every neighbour above a node joins the smallest around that node
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "stars-large")
        # small star: a node and its neighbours below it join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = materialize(small, "stars-small")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                          F.count_distinct("u")).first()
        if state == seen:
            break
        seen = state
    return (stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
