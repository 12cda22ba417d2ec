"""Graphs as edge tables: bounded reachability with paths, and what lies on cycles, each level or round written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.shared import durable


def reach(edges: DataFrame, roots: DataFrame, depth: int, paths: bool = False) -> DataFrame:
    """root, node, depth (and path): each node that edges (a, b) reach from a root in at most `depth` steps, by its fewest steps; the root is left out.

    A pair that is known is not followed again, so cycles end, and the work grows with pairs, not with paths. The edges and each level's
    pairs are written once, so a level is one join, one aggregate and one anti-join over tables. With `paths`, the nodes from the root
    on: of several shortest ways the one through the smallest nodes from the end back.
    """
    edges = durable(edges.select("a", "b"))
    front = durable(roots.select("root", F.col("root").alias("node"), F.array("root").alias("path") if paths else F.lit(0).alias("path")).distinct())
    levels = []
    known = front.select("root", "node")
    for level in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["a"]).groupBy("root", F.col("b").alias("node")).agg(F.min_by("path", "a").alias("path"))
        fresh = step.join(known, ["root", "node"], "left_anti")
        front = durable(fresh.select("root", "node", F.array_append("path", F.col("node")).alias("path") if paths else F.col("path")))
        levels.append(front.withColumn("depth", F.lit(level)))
        known = known.union(front.select("root", "node"))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.select("root", "node", "depth", *(["path"] if paths else []))


def cyclic(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node: the nodes of edges (a, b) that lie on a cycle or between cycles, found by taking off, again and again, the nodes that no edge leaves or
    that none enters. No rows: the graph is acyclic. Self-loops are cycles; repeated edges and nulls don't matter.

    A round is one semi-join each way over a written table that only shrinks. Chains take a round for each two steps of their length, so after
    `rounds` without an end a RuntimeError is raised rather than a wrong answer; raise `rounds` for deeper graphs.
    """
    left = durable(edges.filter("a is not null and b is not null").select("a", "b").distinct())
    n = left.count()
    for _ in range(rounds):
        goes_on = left.select(F.col("a").alias("b")).distinct()
        is_reached = left.select(F.col("b").alias("a")).distinct()
        left = durable(left.join(goes_on, "b", "left_semi").select("a", "b").join(is_reached, "a", "left_semi"))
        now = left.count()
        if now == n:
            return left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        n = now
    raise RuntimeError(f"{n} edges are left after {rounds} rounds")
