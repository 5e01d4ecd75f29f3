"""Connected components of a graph given as a DataFrame of edges, without collecting any of it.

Each round makes every node's larger neighbours point to its least neighbour (large star), then every node and its
smaller neighbours to the least of them (small star); the rounds stop when the edges are stars, after about the
logarithm of the longest path. A node's least neighbour is found by a partially aggregated group and joined back, so a
node that has a third of all edges is never gathered in one place. Edges are first thinned inside each task to a forest,
and every round is cut off by a written table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import drop_table, materialize

MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) of the components of the edges (a, b), one for each node but the least."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        if np.array_equal(before, label) and np.array_equal(label[x], label[y]):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _thin(batches):
    u, v = [], []
    held = 0
    for pdf in batches:
        u.append(pdf.u.to_numpy())
        v.append(pdf.v.to_numpy())
        held += len(pdf)
        if held > 2_000_000:  # memory: what is held shrinks to at most a forest
            a, b = forest(np.concatenate(u), np.concatenate(v))
            if len(a) > 1_000_000:
                yield pd.DataFrame({"u": a, "v": b})
                a, b = a[:0], b[:0]
            u, v, held = [a], [b], len(a)
    if u:
        a, b = forest(np.concatenate(u), np.concatenate(v))
        yield pd.DataFrame({"u": a, "v": b})


def connected_components(edges: DataFrame) -> DataFrame:
    """node long and component long (the smallest node reachable) for every node of edges (u long, v long) that is not
    the smallest of its component. Directions, repeats and loops do not matter; no edges give no rows."""
    thin = edges.select("u", "v").filter("u is not null and v is not null and u <> v").mapInPandas(_thin, "u long, v long")
    stars = materialize(thin, "edges")
    known = None
    if not stars.head(1):
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        state = after.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(stars)
        stars = after
        # a fixed point whose edges are stars: each node points to one, and none of those points further
        if state == known and state[0] == state[1]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        known = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
