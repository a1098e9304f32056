"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and joins back, so a star of any size shrinks by partial aggregation and no
component is ever gathered in one task. Rounds needed grow with the logarithm of the longest path, not with it.

Each round is a checkpoint and some ten jobs that the driver keeps account of. So an edge table of whole numbers that has at
most ``LOCAL`` rows takes no rounds: one task on an executor settles it, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.plans.durable import durable

#: Distinct edges that one task settles, in some 200 bytes each; more take rounds.
LOCAL = 2_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in order and the least one that each reaches: roots hook to lesser ones, at least half of them a turn."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
    for start in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[start : start + 100_000]) for x in (nodes, least)], ["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge, where component is the least node reachable.

    Null ends and loops are ignored, except that a loop's node is its own component unless linked elsewhere.
    Order of rows, repetition and direction do not matter. An empty table gives an empty result.
    """
    raw = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    raw = durable(raw.distinct())
    if {kind for _, kind in raw.dtypes} == {"bigint"} and raw.count() <= LOCAL:
        return durable(raw.coalesce(1).mapInArrow(_settled, "node long, component long"))
    state, now = None, raw.where("u <> v")
    while True:
        now = durable(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    roots = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
