"""Connected components of an edge table, by alternating large-star and small-star rounds on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, durable

#: A node is a hub if it has more than this many edges and more than one in HUBS of all; so there are at most 2 * HUBS hubs.
HUB, HUBS = 1000, 1000
#: Edges that a task connects in one step.
CHUNK = 1 << 20


def star(edges: DataFrame, large: bool, hub_from: int) -> DataFrame:
    """One round over edges (a, b). large: every larger neighbour of a node moves to the node's smallest neighbour or itself;
    else the node and its smaller neighbours do. Sums by key run before the shuffle. The smallest neighbours of hubs, nodes of more
    than `hub_from` edges, are broadcast, so that a hub's edges stay where they are; the others are joined by node."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select("a", F.least("a", "m").alias("m"), "d")
    hubs = F.broadcast(least.filter(F.col("d") > hub_from).select("a", F.col("m").alias("hub_m")))
    marked = both.join(hubs, "a", "left")
    rest = marked.filter("hub_m is null").select("a", "b").join(least.filter(F.col("d") <= hub_from).select("a", "m"), "a")
    moved = marked.filter("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b") if large else out.filter("a <> b").distinct()


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with what each CHUNK of a partition's edges connects as stars around its smallest nodes; nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab")
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = at[: len(a)], at[len(a) :]
            label = np.arange(len(nodes))
            while (label[a] != label[b]).any():
                low = np.minimum(label[a], label[b])
                for side in (label[a], label[b], a, b):
                    np.minimum.at(label, side, low)
                while (label != label[label]).any():
                    label = label[label]
            far = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(run, "a long, b long")


def unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many edges (a, b) there are, and how many nodes keep them from being stars: each a should have one b, which is no a itself."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    each = seen.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("root"))
    n, apart = each.agg(F.sum("leaf"), F.sum(F.expr("leaf > 1 or leaf = 1 and root = 0").cast("long"))).first()
    return n or 0, apart or 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b). No edges: no rows.

    Self-loops and repeated edges don't matter; nulls are dropped. Each task first makes stars of what its own edges connect.
    Each half of a round is written to the shared folder, the one before it is deleted there, and the rounds end when all edges are
    stars; a graph that needs more than `most_rounds` raises an error rather than give wrong components. A star reads its edges in
    several places, so on one that isn't written all of them would plan and run the other star again.
    """
    edges = durable(forests(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(most_rounds):
        n, apart = unsettled(edges)
        if not apart:
            break
        for large in (True, False):
            after = durable(forests(star(edges, large, max(HUB, n // HUBS))))
            discard(edges)
            edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
