"""Connected components: within a task in numpy, over a whole edge table in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_materialized, materialize


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]`` in place; each label is the least index of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) of every node of the edge table; the component is one of its nodes.

    Randomised contraction: each round, every node gives way to the neighbour (or itself)
    of the least hash, so the nodes shrink by a constant factor whatever the graph's
    shape; the number of rounds is logarithmic. Each round's edges and moves are written to
    the shared folder. Joins of a hub's edges are split by adaptive skew handling.
    """
    ids = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct()
    current, moves, seed = materialize(ids, "edges"), [], 0
    while current.limit(1).count():
        seed += 1
        both = current.union(current.select("b", "a"))
        near = F.min(F.struct(F.xxhash64(F.col("b"), F.lit(seed)).alias("h"), F.col("b").alias("v")))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(seed)).alias("h"), F.col("a").alias("v"))
        move = both.groupBy("a").agg(near.alias("m")).select(F.col("a").alias("node"), F.least(own, F.col("m"))["v"].alias("to"))
        move = materialize(move, "moves")
        to_a, to_b = move.toDF("a", "ra"), move.toDF("b", "rb")
        after = current.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        following = materialize(after, "edges")
        drop_materialized(current)
        moves.append(move)
        current = following
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = moves[-1].toDF("node", "component")
    for move in reversed(moves[:-1]):
        known = labels.toDF("to", "component")
        labels = move.join(known, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        labels = materialize(labels, "labels")
    return labels
