"""Conflict-constrained best-fit packing: bins ordered by residual room carry source and duplicate-cluster bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import durable, maybe_among, packed
from attesta.llm.minhash import near_duplicates

#: Tokens (bytes of text) that a bin holds, pieces of one source that a bin holds at most, and the token that closes a text.
CAPACITY, PER_SOURCE, CLOSING = 8192, 4, b"\xff"
#: Documents, and bytes of text, that are packed together, about.
BLOCK, BLOCK_BYTES = 4096, 16 << 20


class Bins:
    """Open bins by residual room. `rooms` has a bit for each residual of some open bin, so the next larger one is a bit search."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.rooms = 0
        self.at: dict[int, dict[int, None]] = {}  # the bins of each residual, the oldest there first
        self.sources: list[list[int]] = []  # per bin: planes; a source's bit in plane k says that the bin has more than k of its documents
        self.clusters: list[int] = []
        self.used: list[int] = []

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.sources[b][-1] & source or self.clusters[b] & cluster)

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin of a piece: the tightest compatible one. Successors of `size` are tried in order of residual, each bin of it in
        order of age; if none is compatible, a new bin opens."""
        rest = self.rooms >> size
        room = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            for b in self.at[room]:
                if self.compatible(b, source, cluster):
                    del self.at[room][b]
                    if not self.at[room]:
                        self.rooms &= ~(1 << room)
                    return self.fill(b, size, source, cluster)
            rest >>= step + 1
            room += 1
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.used.append(0)
        return self.fill(len(self.used) - 1, size, source, cluster)

    def fill(self, b: int, size: int, source: int, cluster: int) -> int:
        planes = self.sources[b]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break
        self.clusters[b] |= cluster
        self.used[b] += size
        room = self.capacity - self.used[b]
        if room:
            self.at.setdefault(room, {})[b] = None
            self.rooms |= 1 << room
        return b


def bits(values: np.ndarray, shared_only: bool) -> list[int]:
    """A bit for each different value, exactly: equal values have the same one. shared_only: 0 for values that occur once."""
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.cumsum(count > 1) - 1 if shared_only else np.arange(len(count))
    return [0 if shared_only and count[x] == 1 else 1 << int(order[x]) for x in number]


PARTS = "array<struct<doc_id:long,piece:int,first:int,n:int,whole:long>>"
BINS = f"block long, bin int, used int, tokens binary, parts {PARTS}"
PART_SCHEMA = [("doc_id", pa.int64()), ("piece", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("whole", pa.int64())]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """A row for each bin: block and bin, how many tokens are used, the tokens, and its parts: each a piece of a document by its first
    token in the bin and its number of tokens; `whole` is the document's number of tokens.

    Tokens are the bytes of UTF-8 texts, and each text ends with the token CLOSING, a byte that UTF-8 never uses; so every text
    takes a token at least, null and empty ones too. A text longer than a bin is cut into pieces that fill whole bins,
    and a rest. A bin has at most `per_source` pieces of a source, and no two of one
    duplicate cluster: `cluster` is a column, or else equal texts are a cluster; rows with a null there are alone, but the
    pieces of one row count as a cluster too. Null sources are one source. Documents are dealt to blocks of about BLOCK by a hash of id and text, so
    that a source or cluster of any share spreads over all blocks; a block packs in order of size, then doc_id and
    place. Repeated rows are packed apart. Other columns are dropped.
    """
    alone = F.concat_ws(" ", F.lit("row"), F.col(key).cast("string"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"))
    cluster_of = F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), alone) if cluster else F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    blocks = max(1, total[0] // BLOCK, (total[1] or 0) // BLOCK_BYTES)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))).alias("s"),
        F.xxhash64(cluster_of).alias("c"), F.pmod(F.xxhash64(F.lit(29), F.col(key).cast("long"), F.col(text)), F.lit(blocks)).alias("block"),
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("t").chunk(0) if table.num_rows else pa.array([], pa.string())
        data, bounds = packed(texts)
        s, c = (table.column(n).to_numpy() for n in ("s", "c"))
        ids = table.column("doc_id")
        number = ids.to_numpy()
        sizes = np.diff(bounds) + 1
        pieces = -(-sizes // capacity)
        row = np.repeat(np.arange(len(number)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n = np.minimum(sizes[row] - piece * capacity, capacity)
        order = np.lexsort((piece, number[row], -n))
        of_source, of_cluster = bits(s[row], False), bits(c[row], True)
        bins = Bins(capacity, per_source)
        place = np.zeros(len(row), np.int64)
        for i in order.tolist():
            place[i] = bins.put(int(n[i]), of_source[i], of_cluster[i])
        inside = order[np.argsort(place[order], kind="stable")]  # pieces by bin, in the order in which they came
        size, skipped = n[inside], piece[inside] * capacity
        begin = bounds[:-1][row[inside]] + skipped
        closes = skipped + size == sizes[row[inside]]
        view, runs = memoryview(data), []
        for at, upto, last in zip(begin.tolist(), (begin + size - closes).tolist(), closes.tolist(), strict=True):
            runs.append(view[at:upto])
            if last:
                runs.append(CLOSING)
        used = np.array(bins.used, np.int64)
        content = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets(used).astype(np.int32)), pa.py_buffer(b"".join(runs))])
        first = offsets(size)[:-1] - offsets(used)[:-1][place[inside]]
        fields = [ids.take(pa.array(row[inside])).combine_chunks(), piece[inside], first, size, sizes[row[inside]]]
        fields = [f if isinstance(f, pa.Array) else f.chunk(0) if isinstance(f, pa.ChunkedArray) else pa.array(f, k) for f, (_, k) in zip(fields, PART_SCHEMA, strict=True)]
        parts = pa.ListArray.from_arrays(pa.array(offsets(np.bincount(place, minlength=len(used))), pa.int32()), pa.StructArray.from_arrays(fields, names=[f for f, _ in PART_SCHEMA]))
        columns = [pa.array(np.full(len(used), key[0].as_py())), pa.array(np.arange(len(used)), pa.int32()), pa.array(used, pa.int32()), content, parts]
        return pa.table(columns, names=["block", "bin", "used", "tokens", "parts"])

    return rows.groupBy("block").applyInArrow(run, BINS)


PIECES = "doc_id long, piece int, n_tokens int, doc_tokens long, block long, bin int, bin_used int, n_bytes long, piece_sha256 string"


def unpack(bins: DataFrame) -> DataFrame:
    """A row for each part of each bin, read back from its tokens: the size and digest of its bytes, without the closing token."""
    cut = F.transform("parts", lambda p: F.struct(p.alias("p"), F.substring(F.col("tokens"), p["first"] + 1, p["n"]).alias("back")))
    part = bins.select("block", "bin", "used", F.inline(cut))  # a part carries its own tokens only
    closes = F.substring("back", F.col("p.n"), F.lit(1)) == F.lit(CLOSING)
    text = F.when(closes, F.substring("back", F.lit(1), F.col("p.n") - 1)).otherwise(F.col("back"))
    return part.select(
        "p.doc_id", "p.piece", F.col("p.n").alias("n_tokens"), F.col("p.whole").alias("doc_tokens"), "block", "bin", F.col("used").alias("bin_used"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("piece_sha256"),
    )


def with_clusters(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with near_duplicate: the component of near duplicates, of two or more documents, that a document is in, or null.

    Rows with a null id have none. The members of a component are those that aren't kept, and the one that is. They are written once, and
    only texts that may be theirs move to be joined with them."""
    others = near_duplicates(docs, text, key).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("of_"), F.col("component_id").alias("near_duplicate"))
    roots = others.select(F.col("near_duplicate").alias("of_"), "near_duplicate")
    some = durable(others.unionByName(roots).distinct())
    told = maybe_among(F.col(key), docs, some.select("of_"), "maybe_")
    few, rest = told.filter("maybe_").drop("maybe_"), told.filter("not maybe_").drop("maybe_")
    own = few.join(some, F.col(key).cast("long") == F.col("of_"), "left").drop("of_")
    return own.unionByName(rest.withColumn("near_duplicate", F.lit(None).cast("long")))
