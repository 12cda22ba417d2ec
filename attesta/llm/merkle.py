"""Merkle manifest of a dataset: blocks of leaves are reduced on executors, the small top of the tree on the driver, whose suffix paths
are broadcast so that executors finish each row's proof and fold it."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import durable, placed

#: Nodes of a run; nodes of a block (a power of RUN); nodes that the driver takes at most.
RUN, BLOCK, TOP = 3, 3**8, 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path from a node up: (before, after, path of its parent), the digests of its siblings on both sides in a row; at the root None.
#: Where a source's tree ends, (None, subroot, path of the subroot).
Path = tuple[str | None, str, "Path"] | None


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def climb(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels of a tree from its leaves up, so many or until one node remains."""
    tree = [nodes]
    while len(tree) - 1 < levels if levels is not None else len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([h("".join(low[i : i + RUN])) for i in range(0, len(low), RUN)])
    return tree


def paths(tree: list[list[str]], above: Path) -> list[Path]:
    """The path of each leaf of a tree whose last level's one node has the path `above`. Paths share their upper parts."""
    found = [above]
    for low in reversed(tree[:-1]):
        found = [("".join(low[i - i % RUN : i]), "".join(low[i + 1 : i - i % RUN + RUN]), found[i // RUN]) for i in range(len(low))]
    return found


def fold(node: str, path: Path) -> str:
    """The root that a node gives with its siblings."""
    while path is not None:
        if path[0] is not None:
            node = h(path[0] + node + path[1])
        path = path[2]
    return node


def proof(path: Path) -> tuple[str, str]:
    """The subroot on a path, and the digest of all siblings on it, level by level, left to right."""
    parts, subroot = [], None
    while path is not None:
        if path[0] is not None:
            parts += path[:2]
        elif subroot is None:
            subroot = path[1]
        path = path[2]
    return subroot, h("".join(parts))


def framed(value: Column) -> Column:
    """`-` if null, else byte count, colon, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(framed, fields)), 256)


def blocks_of(nodes: DataFrame, block: int):
    """nodes (tree, pos, count, ...) by block of consecutive ones. count is that of the whole tree's nodes on this level."""
    return nodes.withColumn("block", F.floor(F.col("pos") / block)).groupBy("tree", "block")


def block_tree(table: pa.Table, block: int) -> tuple[pa.Table, list[list[str]]]:
    """A block's rows in order, and its levels: one node remains of a tree that is this block alone; of one of several blocks each
    climbs the block's full height, so that heights agree."""
    table = table.sort_by("pos")
    height = None
    if table.column("count")[0].as_py() > block:
        height, size = 0, 1
        while size < block:
            height, size = height + 1, size * RUN
    return table, climb(table.column("digest").to_pylist(), height)


def roots(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes that remain of each block: tree, pos, count, digest one level of blocks up. One row a block moves on."""

    def run(table: pa.Table) -> pa.Table:
        table, tree = block_tree(table, block)
        tree_id, number, count = table.column("tree")[0].as_py(), table.column("block")[0].as_py(), table.column("count")[0].as_py()
        return pa.table({"tree": [tree_id], "pos": [number], "count": [-(-count // block)], "digest": tree[-1]})

    return durable(blocks_of(nodes, block).applyInArrow(run, "tree long, pos long, count long, digest string"))


def top(nodes: DataFrame) -> tuple[str, dict[tuple[int, int], Path]]:
    """The root, and the path of each of a few nodes: the driver ends each tree, then the tree of the trees' roots in their order."""
    members: dict[int, list[str]] = {}
    for t, _, digest in sorted(tuple(r) for r in nodes.select("tree", "pos", "digest").collect()):
        members.setdefault(t, []).append(digest)
    if not members:
        return "", {}
    trees = {t: climb(digests) for t, digests in members.items()}
    upper = climb([tree[-1][0] for tree in trees.values()])
    found = {}
    for (t, tree), above in zip(trees.items(), paths(upper, None), strict=True):
        found |= {(t, p): path for p, path in enumerate(paths(tree, (None, tree[-1][0], above)))}
    return upper[-1][0], found


def flat(path: Path) -> list[dict[str, str]]:
    steps = []
    while path is not None:
        steps.append({"before": path[0], "after": path[1]})
        path = path[2]
    return steps


def nested(steps: list[dict[str, str]]) -> Path:
    path = None
    for s in reversed(steps):
        path = (s["before"], s["after"], path)
    return path


def below(nodes: DataFrame, above, block: int, finish, schema: str) -> DataFrame:
    """finish(rows of a block, path of each row) over all blocks. above: the paths of blocks, a broadcast of the top's
    or a table (tree, pos, path) that is dealt with the blocks."""
    if isinstance(above, DataFrame):

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            table, tree = block_tree(left, block)
            return finish(table, paths(tree, nested(right.column("path")[0].as_py())))

        return blocks_of(nodes, block).cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(both, schema)

    def run(table: pa.Table) -> pa.Table:
        table, tree = block_tree(table, block)
        return finish(table, paths(tree, above.value[table.column("tree")[0].as_py(), table.column("block")[0].as_py()]))

    return blocks_of(nodes, block).applyInArrow(run, schema)


def path_rows(table: pa.Table, found: list[Path]) -> pa.Table:
    """Paths as rows. A subroot's path leads on from the one node of its source's tree."""
    trees, places = table.column("tree"), table.column("pos")
    if "lower" in table.column_names:
        trees, places = table.column("lower"), pa.array([0] * table.num_rows, pa.int64())
        found = [(None, digest, p) for digest, p in zip(table.column("digest").to_pylist(), found, strict=True)]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"tree": trees, "pos": places, "path": pa.array([flat(p) for p in found], kind)})


def manifest(docs: DataFrame, block: int = BLOCK, most: int = TOP, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root (from the tampered leaf) and verified, for each row.

    docs has FIELDS. tampered is the text as found later; without it, nothing is tampered with. Texts are hashed where they are read.
    Leaves are ordered in ranges by source and doc_id; blocks of `block` of them become one node each, again and again until `most`
    nodes are left at most; if there are more sources than that, blocks of subroots do likewise. The driver ends the tree and broadcasts
    the paths of these nodes, a bounded number. Executors then build each block's inner paths, fold every row and compare.
    A lost executor's blocks are computed anew from tables in the shared folder; the same rows give the same manifest.

    Nulls are `-`, also doc_id and source: null sources are one source, the first, and null ids come first in a source. Rows of equal
    ids come in order of their leaves; equal rows are leaves of their own, and it doesn't matter which is which. An empty text isn't a
    null one. Other columns are dropped. An empty table gives no rows.
    """
    if block != RUN ** (len(climb([""] * block)) - 1):
        raise ValueError(f"a block is a power of {RUN}")
    spark = docs.sparkSession
    own = leaf(*map(F.col, FIELDS))
    other = own if tampered is None else leaf(*map(F.col, FIELDS[:-1]), tampered)
    hashed = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("digest"), F.nullif(other, own).alias("changed")))
    order = placed(hashed, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), dealt_by=2)
    trees = order.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("count")).withColumnRenamed("source", "of")
    leaves = order.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("tree", (F.col("place") - F.col("tree")).alias("pos"), "count", "digest", "doc_id", "changed")

    done = [leaves]
    nodes = roots(leaves, block)
    while nodes.count() > most:
        if nodes.filter("count > 1").isEmpty():  # subroots only: their own tree, in order of their sources
            ranked = placed(nodes.select(F.col("tree").alias("lower"), "digest"), F.col("lower"))
            ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("count"))))
            nodes = durable(ranked.select(F.lit(-1).cast("long").alias("tree"), F.col("place").alias("pos"), "count", "digest", "lower"))
        done.append(nodes)
        nodes = roots(nodes, block)
    root, found = top(nodes)
    above = spark.sparkContext.broadcast(found)
    for nodes in reversed(done[1:]):
        above = durable(below(nodes, above, block, path_rows, "tree long, pos long, path array<struct<before: string, after: string>>"))

    def finish(table: pa.Table, found: list[Path]) -> pa.Table:
        own, changed = table.column("digest"), table.column("changed").to_pylist()
        subroots, proofs = zip(*map(proof, found), strict=True)
        folded = [fold(b or a, p) for a, b, p in zip(own.to_pylist(), changed, found, strict=True)]
        columns = {"doc_id": table.column("doc_id"), "leaf": own, "subroot": subroots, "root": [root] * len(folded), "proof_sha256": proofs, "folded_root": folded}
        return pa.table(columns | {"verified": [f == root for f in folded]})

    return below(leaves, above, block, finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
