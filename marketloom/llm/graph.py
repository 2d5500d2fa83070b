"""Connected components of edge tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut

_HELD_EDGES = 500_000


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected index of each of n nodes under edges a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches):
    """Replace the edges of a task by a star per component that they form."""

    def star(parts):
        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(places[: len(a)], places[len(a) :], len(nodes))
        own = label != np.arange(len(nodes))
        return pa.record_batch({"a": pa.array(nodes[own]), "b": pa.array(nodes[label[own]])})

    parts, held = [], 0
    for batch in batches:
        parts.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        held += batch.num_rows
        if held >= _HELD_EDGES:
            yield star(parts)
            parts, held = [], 0
    if held:
        yield star(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    Edges are columns a and b of longs, in any order, repeated or not. Tasks first contract their own
    edges. Then every node's larger neighbours move to its smallest neighbour (large star), and its
    smaller neighbours likewise (small star), until nothing changes. Neighbours are reduced by
    aggregation, so a node with very many edges is never gathered in one place.
    """
    stars = cut(edges.where("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    state = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
