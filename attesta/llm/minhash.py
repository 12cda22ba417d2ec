"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures, links confirmed on full shingle sets.

1. Each document gets its shingle set's size, a key of the set and a signature of SLOTS slots of 16 bits. Equal sets are one class.
2. Two classes over the threshold differ in at most error_bound() slots. Signatures are cut into chunks, so few that by pigeonhole
   one chunk of such a pair holds at most CHUNK_ERRORS errors; all choices of so many slots of a chunk are left out in turn, and
   each gives a key. So every pair under the bound shares a key.
3. Of a key's classes, pairs whose signatures differ in no more slots than the bound become edges. A key of two classes is such a
   pair itself; larger ones meet in blocks of CROWD at most, with one common member; only classes that are still apart
   then meet across blocks.
4. The edges' components are families. Full shingle sets decide within them, in tiles, by the same two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, durable, maybe_among, mix, packed, slices, word_bounds, word_hashes
from attesta.llm.components import components

SLOTS = 128
#: Bits of a slot by which signatures are compared; keys are made of all 16.
PLANES = 4
#: Errors that a chunk may hold; pigeonhole then needs (errors of a signature + 1) / (CHUNK_ERRORS + 1) chunks.
CHUNK_ERRORS = 1
#: Chance, at most, that a pair right at the threshold differs in more slots than the bound.
MISS = 1e-6
#: Classes of one key that a block of signatures holds; classes, and hashes of their sets, that a tile of exact checks holds.
CROWD, TILE, TILE_HASHES = 4096, 1024, 8 << 20
#: Rows that one step of comparing signatures works on.
STEP = 50_000
_RANDOM = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).astype(np.uint32)
FLIP, TURN = _RANDOM[:SLOTS, None], _RANDOM[SLOTS:, None] | np.uint32(1)
SPREAD = np.uint64(0x9FB21C651E98DF25)


def error_bound(percent: int) -> int:
    """Slots in which the signatures of two sets of that similarity may differ: all but MISS of such pairs differ in no more.

    Slots differ independently with chance 1 - similarity. The bound is rounded up to what the chunks cover anyway.
    """
    p = 1 - percent / 100
    tail, t = 1.0, -1
    while tail > MISS and t < SLOTS:
        t += 1
        tail -= comb(SLOTS, t) * p**t * (1 - p) ** (SLOTS - t)
    return chunk_count(t) * (CHUNK_ERRORS + 1) - 1


def chunk_count(errors: int) -> int:
    return min(SLOTS, -(-(errors + 1) // (CHUNK_ERRORS + 1)))


def chunk_bounds(errors: int) -> list[tuple[int, int]]:
    n = chunk_count(errors)
    cuts = [SLOTS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; with fewer words than `width`, of the whole sequence."""
    data, bounds = packed(texts)
    data = LOWER[data]
    starts, ends, of = word_bounds(data, bounds)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(of, np.arange(len(bounds)))
    sets = []
    joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        joined = mix(joined * SPREAD + hashes[i : i + len(joined)])
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            sets.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in hashes[a:b]:
                h = mix(np.array([h]) * SPREAD + x)[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(members: np.ndarray) -> bytes | None:
    """Sixteen bytes that stand for a set; none for the empty one."""
    return np.array([members.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(members + np.uint64(7)))], np.uint64).tobytes() if len(members) else None


def signature(members: np.ndarray) -> np.ndarray:
    """The low 16 bits of a mix of each slot's minimum."""
    low = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    short = (members >> np.uint64(32)).astype(np.uint32) ^ members.astype(np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(low, ((short[None, i : i + 1024] ^ FLIP) * TURN).min(1), out=low)
    return (mix(low.astype(np.uint64) + np.uint64(1)) & np.uint64(0xFFFF)).astype(np.uint16)


SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary"


def signatures(docs: DataFrame, width: int, text: str, key: str, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, set_key, sig and mark (a whole number, or null if none is given), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                sets = shingle_sets(batch.column("t"), width)
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                columns = [batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("m")], names=["doc_id", "n_shingles", "set_key", "sig", "mark"])

    marked = (F.lit(None) if mark is None else mark).cast("long").alias("m")
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), marked).mapInArrow(run, f"{SIGNED}, mark long")


def full_sets(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """rep (a doc_id), set_key and the whole shingle set as packed hashes, once for each set of a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                sets = shingle_sets(batch.column("t"), width)
                columns = [batch.column("k"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "set_key", "members"])

    rows = docs.selectExpr(f"cast({key} as long) k", f"{text} t").mapInArrow(run, "rep long, set_key binary, members binary")
    return rows.dropDuplicates(["rep", "set_key"])


def chunk_variants(sig: np.ndarray, errors: int) -> np.ndarray:
    """Signature by key: for each chunk, its value with each choice of CHUNK_ERRORS slots left out."""
    out = []
    for c, (a, b) in enumerate(chunk_bounds(errors)):
        for v, left in enumerate(combinations(range(a, b), min(CHUNK_ERRORS, b - a))):
            h = np.full(len(sig), (c << 20) + v + 1, np.uint64)
            for s in range(a, b):
                if s not in left:
                    h = mix(h * SPREAD + sig[:, s])
            out.append(h)
    return np.stack(out, 1)


def unpacked(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, SLOTS)


def index_keys(reps: DataFrame, errors: int) -> DataFrame:
    """key, rep: one row for each chunk variant of each class. As a class becomes over a hundred rows, classes are dealt to as many tasks as
    there are shuffle partitions, so that a task makes few."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                keys = chunk_variants(unpacked(part.column("sig")), errors)
                rep = np.repeat(part.column("rep").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "sig").repartition(parts, "rep").mapInArrow(run, "key long, rep long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows (key, rep) whose key another row has too. Most keys are one class's only; rows are dealt and sorted by key once, and those
    that are like neither neighbour go as they stream by, so a key of any number of rows takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rep, told = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether it is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in ((key, "key"), (rep, "rep")))
            same = key[1:] == key[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            last = bool(keep[-1])
            if told and len(key) > batch.num_rows:
                keep[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rep[keep])], names=["key", "rep"])
            key, rep, told = key[-1:], rep[-1:], last

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, rep long")


def planes(sigs: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of each slot as bit planes: signature by plane and word."""
    bits = [np.packbits((sigs >> np.uint16(k)).astype(np.uint8) & 1, axis=1) for k in range(PLANES)]
    return np.concatenate(bits, axis=1).view(np.uint64)


def low_bits(reps: DataFrame) -> DataFrame:
    """rep, n and the planes of its signature: two signatures differ there in no more slots than as a whole, so no pair is lost by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = planes(unpacked(batch.column("sig"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], names=["rep", "n", "low"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, low binary")


def plane_rows(low: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(low.to_pylist()), np.uint64).reshape(-1, PLANES, SLOTS // 64)


def near(low_a: np.ndarray, low_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, errors: int) -> np.ndarray:
    """Whether planes differ in `errors` slots at most, and sizes allow the similarity."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    differ = np.bitwise_or.reduce(low_a ^ low_b, axis=-2)
    return fits & (np.bitwise_count(differ).sum(-1, dtype=np.int64) <= errors)


def edge_batch(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_pairs(pairs: DataFrame, low: DataFrame, percent: int, errors: int) -> DataFrame:
    """Of pairs (a, b), those with near signatures. A class is in few pairs: it has one key for each slot at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            ok = near(plane_rows(batch.column("low_a")), plane_rows(batch.column("low_b")), n_a, n_b, percent, errors)
            yield edge_batch(a[ok], b[ok])

    for side in "ab":
        pairs = pairs.join(low.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("low").alias(f"low_{side}")), side)
    return pairs.mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by `names` as tables of whole groups, of about STEP rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STEP:
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(table.num_rows, bool)
            for n in names:
                x = table.column(n).to_numpy()
                last &= x == x[-1]
            cut = int(last.argmax())
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
            else:
                held = table.to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def cuts_of(table: pa.Table, names: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows + 1, bool)
    fresh[[0, -1]] = True
    for n in names:
        x = table.column(n).to_numpy()
        fresh[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def near_edges(rows: DataFrame, percent: int, errors: int) -> DataFrame:
    """Edges (a, b) that connect, within each (key, block), the members whose signatures are near: a spanning forest of each.

    rows: key, block, rep, n, low; CROWD members of a block at most, and its pivot. Every member is compared with the group's first
    one in one step over many groups; where some are far from it, they are compared with the others too, tree by tree.
    """
    names = ["key", "block"]

    def forest(rep: np.ndarray, n: np.ndarray, low: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
        for i in range(1, len(rep)):
            others = np.flatnonzero(label != label[i])
            others = others[(others > i) | (label[others] == 0)]
            if not len(others):
                continue
            ok = near(low[others], low[i], n[others], n[i], percent, errors)
            for x in others[ok]:
                if label[x] != label[i]:
                    yield int(rep[i]), int(rep[x])
                    least, most = sorted((label[x], label[i]))
                    label[label == most] = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, names):
            rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
            low = plane_rows(table.column("low"))
            cuts = cuts_of(table, names)
            sizes = np.diff(cuts)
            pivot = np.repeat(cuts[:-1], sizes)
            ok = near(low, low[pivot], n, n[pivot], percent, errors)
            hit = np.flatnonzero(ok & (pivot != np.arange(len(rep))))
            yield edge_batch(rep[pivot[hit]], rep[hit])
            apart = np.add.reduceat(~ok, cuts[:-1])
            found = []
            for g in np.flatnonzero((apart > 0) & (sizes > 2)):
                a, b = cuts[g], cuts[g + 1]
                found += forest(rep[a:b], n[a:b], low[a:b], np.where(ok[a:b], 0, np.arange(b - a)))
            if found:
                yield edge_batch(*map(list, zip(*found, strict=True)))

    return rows.repartition(*names).sortWithinPartitions(*names, "rep").mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, group: str, blocks: str, pivot: str) -> DataFrame:
    """members with `block`: a hash's choice of `blocks`; the member `pivot` of each group is in all of them, so that they connect there."""
    own = F.pmod(F.xxhash64("rep"), F.col(blocks))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    return members.withColumn("block", F.explode(F.when(F.col("rep") == F.col(pivot), everywhere).otherwise(F.array(own))))


def across(members: DataFrame, group: str, most: int) -> DataFrame:
    """members (group, rep, label, n) in tiles (group, i, j, side) where any two with different labels meet, one of each side.

    The group's largest label takes side 0 only, so its members never meet each other. Groups of one label vanish.
    """
    sizes = members.groupBy(group, "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    whole = sizes.groupBy(group).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.max("c").alias("top")).filter("top < c")
    blocks = f"cast(ceil(greatest(c / {most}, n / {TILE_HASHES})) as long)"
    out_blocks = f"cast(ceil(greatest((c - top) / {most}, n / {TILE_HASHES})) as long)"
    rows = members.join(whole.selectExpr(group, "main", f"{blocks} bj", f"{out_blocks} bi"), group)
    h = F.xxhash64("rep")
    zero = F.lit(0).cast("long")
    every = rows.withColumn("side", F.lit(0)).withColumn("j", F.pmod(h, "bj")).withColumn("i", F.explode(F.sequence(zero, F.col("bi") - 1)))
    out = rows.filter("label <> main").withColumn("side", F.lit(1)).withColumn("i", F.pmod(h, "bi")).withColumn("j", F.explode(F.sequence(zero, F.col("bj") - 1)))
    names = [group, "i", "j", "side", "rep", "label"]
    return every.select(*names).unionByName(out.select(*names))


def near_across(tiles: DataFrame, percent: int, errors: int) -> DataFrame:
    """Edges (a, b) of near signatures between the two sides of each tile (key, i, j)."""
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, names):
            rep, n, side, label = (table.column(c).to_numpy() for c in ("rep", "n", "side", "label"))
            low = plane_rows(table.column("low"))
            found = set()
            for a, b in zip(*(lambda c: (c[:-1], c[1:]))(cuts_of(table, names)), strict=True):
                zero = np.flatnonzero(side[a:b] == 0) + a
                for x in np.flatnonzero(side[a:b] == 1) + a:
                    ok = zero[near(low[zero], low[x], n[zero], n[x], percent, errors) & (label[zero] != label[x])]
                    _, once = np.unique(label[ok], return_index=True)
                    found |= {(int(rep[x]), int(rep[y])) for y in ok[once]}
            if found:
                yield edge_batch(*map(list, zip(*sorted(found), strict=True)))

    return tiles.repartition(*names).sortWithinPartitions(*names, "side", "rep").mapInArrow(run, "a long, b long")


def exact_links(tiles: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that connect what links within each tile (`names`) connect.

    tiles: names, rep, label, members. Rows of one label count as connected. Shared hashes are numbered, and blocks of a
    0/1 matrix product count intersections, so memory is bounded by the tile.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), size)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count[code] > 1
        number = np.cumsum(count > 1) - 1
        code, row = number[code[often]], row[often]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, (32 << 20) // (4 * len(sets)))
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            p, q = np.searchsorted(code, (lo, lo + width))
            m = np.zeros((len(sets), min(width, int(code[-1]) + 1 - lo)), np.float32)
            m[row[p:q], code[p:q] - lo] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
        linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        a, b = [], []
        for i in range(len(sets)):
            for x in np.flatnonzero(linked[i] & (label != label[i])):
                if label[x] != label[i]:
                    a.append(rep[i])
                    b.append(rep[x])
                    label[label == label[x]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy(*names).applyInArrow(run, "a long, b long")


def candidate_families(reps: DataFrame, percent: int) -> DataFrame:
    """rep, family: the components of all pairs of classes whose signatures differ in error_bound() slots at most."""
    errors = error_bound(percent)
    keys, low = durable(shared_keys(index_keys(reps, errors))), low_bits(reps)
    groups = durable(keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("least"), F.max("rep").alias("most")))
    pairs = groups.filter("c = 2 and least < most").select(F.col("least").alias("a"), F.col("most").alias("b")).distinct()
    crowds = groups.filter("c > 2").select("key", "least", "c", F.ceil(F.col("c") / CROWD).alias("blocks"))
    members = keys.join(crowds, "key")
    rows = in_blocks(members, "key", "blocks", "least").join(low, "rep").select("key", "block", "rep", "n", "low")
    edges = near_pairs(pairs, low, percent, errors).unionByName(near_edges(rows, percent, errors)).distinct()
    families = durable(components(edges).select(F.col("node").alias("rep"), F.col("component").alias("family")))
    if (groups.agg(F.max("c")).first()[0] or 0) > CROWD:
        hot = members.filter("blocks > 1").join(families, "rep", "left").select("key", "rep", F.coalesce("family", "rep").alias("label"), F.lit(0).alias("n"))
        tiles = across(hot, "key", CROWD).join(low, "rep")
        more = near_across(tiles, percent, errors)
        known = families.select(F.col("rep").alias("a"), F.col("family").alias("b"))
        families = durable(components(known.unionByName(more)).select(F.col("node").alias("rep"), F.col("component").alias("family")))
    return families


def linked_classes(families: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """rep, component: classes that links on full sets connect, within each family."""
    members = families.join(reps.select("rep", "set_key", "n"), "rep")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_HASHES)).alias("blocks"))
    members = durable(members.join(sizes, "family"))
    ids = members.select(F.col("rep").alias(key)).distinct()
    few = maybe_among(F.col(key), docs, ids, "maybe_").filter("maybe_").drop("maybe_")  # the other texts stay where they are
    sets = full_sets(few.join(ids, key, "left_semi"), width, text, key)
    tiles = in_blocks(members, "family", "blocks", "family").join(sets, ["rep", "set_key"]).withColumn("label", F.xxhash64("set_key"))
    found = components(exact_links(tiles.select("family", "block", "rep", "label", "members"), ["family", "block"], percent))
    if (members.agg(F.max("blocks")).first()[0] or 0) > 1:
        found = durable(found)
        labelled = members.filter("blocks > 1").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        apart = across(labelled.select("family", "rep", "label", "n"), "family", TILE).join(reps.select("rep", "set_key"), "rep").join(sets, ["rep", "set_key"])
        more = exact_links(apart.select("family", "i", "j", "rep", "label", "members"), ["family", "i", "j"], percent)
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(known.unionByName(more))
    return found.withColumnRenamed("node", "rep")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document.

    Documents link if 100 * |A & B| >= percent * |A | B| on their sets of `width`-word shingles; component_id is the smallest
    doc_id reachable. Texts without a word, null texts included, have an empty set and link with nothing. Equal sets are one class, so
    groups of copies of any size cost one signature. Null ids are no class's representative: such a row belongs to the class of
    its set, if others have it, or stays. Repeated doc_ids give repeated rows, each judged by its text; where one id stands
    for several classes, these count as one. Other columns are dropped; `mark`, a whole number of each row, comes out as a column of that name.
    """
    signed = durable(signatures(docs, width, text, key, mark))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = durable(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))
    linked = linked_classes(candidate_families(reps, percent), reps, docs, width, percent, text, key)
    classes = reps.select("set_key", "rep").join(linked, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *([] if mark is None else ["mark"]))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
