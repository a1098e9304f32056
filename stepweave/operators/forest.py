"""Spanning forests of pair findings, and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.components import connected_components
from stepweave.plans.durable import durable

MIN_CLUSTER = 5


def all_pairs_forest(rows: DataFrame, group: list[str], node: str = "def_id") -> DataFrame:
    """Of all pairs a < b of a group those that a spanning forest by (a, b) may keep, by the group's other columns of a.

    Any other pair closes a cycle with two lesser ones, (least, a) and (least, b), whatever further edges there are. So the
    star of the least is enough, and the pairs are not made.
    """
    others = [c for c in rows.columns if c not in (*group, node)]
    least = rows.groupBy(*group).agg(F.min(F.struct(F.col(node).alias("a"), *others)).alias("x")).select(*group, "x.*").hint("merge")
    return rows.select(*group, F.col(node).alias("b")).join(least, group).where("a < b")


def numbered(edges: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes: g, node, id; edges with g and the ids of their ends): whole numbers link faster than groups and nodes in words."""
    own = edges.withColumn("g", F.to_json(F.struct(*group)))
    nodes = durable(own.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    end = lambda c: nodes.select("g", F.col("node").alias(c), F.col("id").alias(f"i{c}")).hint("merge")
    return nodes, durable(own.join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"]))


def spanning_forest(edges: DataFrame, group: list[str]) -> DataFrame:
    """A5: of each group's edges (a < b) those that Kruskal keeps when it takes them in (a, b) order.

    A component with as many edges as a tree is kept as it is. Others are reduced by Boruvka rounds: each component takes its
    least outgoing edge. With a total order on edges the minimum spanning forest is unique, so this is what Kruskal keeps, and
    no component has to fit in one task.
    """
    _, own = numbered(edges, group)
    found = connected_components(own, "ia", "ib").toDF("ia", "component")
    placed = own.join(found.hint("merge"), "ia")
    size = found.groupBy("component").agg(F.count("*").alias("n"))
    trees = placed.groupBy("component").agg(F.count("*").alias("e")).join(size.hint("merge"), "component").where("e = n - 1").select("component").hint("merge")
    whole = placed.join(trees, "component", "left_semi").select(*edges.columns)
    rest = durable(placed.join(trees, "component", "left_anti").drop("component"))
    if rest.isEmpty():
        return whole
    label = rest.select(F.explode(F.array("ia", "ib")).alias("id")).distinct().withColumn("root", F.col("id"))
    chosen, links = None, rest.select("ia", "ib", F.struct("a", "b", "ia", "ib").alias("e"))
    while True:
        la = label.select(F.col("id").alias("ia"), F.col("root").alias("ra")).hint("merge")
        lb = label.select(F.col("id").alias("ib"), F.col("root").alias("rb")).hint("merge")
        crossing = durable(links.join(la, "ia").join(lb, "ib").where("ra <> rb"))
        if crossing.isEmpty():
            break
        ends = crossing.select(F.col("ra").alias("r"), "rb", "ra", "e").union(crossing.select(F.col("rb").alias("r"), "rb", "ra", "e"))
        picked = durable(ends.groupBy("r").agg(F.min(F.struct("e", "ra", "rb")).alias("x")).select("x.e.ia", "x.e.ib", "x.ra", "x.rb").distinct())
        chosen = picked.select("ia", "ib") if chosen is None else chosen.union(picked.select("ia", "ib"))
        # contract: components of roots linked by picked edges
        moved = connected_components(picked, "ra", "rb").toDF("root", "to").hint("merge")
        label = durable(label.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        links = crossing.select("ia", "ib", "e")
    if chosen is None:
        return whole
    return whole.unionByName(rest.join(chosen.distinct().hint("merge"), ["ia", "ib"], "left_semi").select(*edges.columns))


def components_by(edges: DataFrame, group: list[str]) -> DataFrame:
    """A4: (g, node, component) per group of edges."""
    nodes, own = numbered(edges, group)
    found = nodes.join(connected_components(own, "ia", "ib").toDF("id", "c").hint("merge"), "id")
    least = found.groupBy("c").agg(F.min("node").alias("component")).hint("merge")
    return found.join(least, "c").select("g", "node", "component")


def clusters(edges: DataFrame, group: list[str], least: int = MIN_CLUSTER) -> DataFrame:
    """Components of at least ``least`` definitions: the group's columns, component, members (ascending), first edge."""
    labelled = durable(components_by(edges, group))
    sizes = labelled.groupBy("g", "component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("g", "component").hint("merge")
    members = labelled.join(sizes, ["g", "component"]).groupBy("g", "component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    firsts = edges.withColumn("g", F.to_json(F.struct(*group))).join(labelled.select("g", F.col("node").alias("a"), "component").hint("merge"), ["g", "a"]).groupBy("g", "component", *group).agg(F.min(F.struct("a", "b")).alias("edge"))
    return members.join(firsts.hint("merge"), ["g", "component"]).drop("g")


def union_find_forest(edges: pa.Table) -> pa.Table:
    """The same forest for edges that fit in memory; the tests' model."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def kept() -> Iterator[tuple[int, int]]:
        for a, b in sorted(zip(edges.column("a").to_pylist(), edges.column("b").to_pylist())):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield a, b

    rows = list(kept())
    return pa.table({"a": [a for a, _ in rows], "b": [b for _, b in rows]})
