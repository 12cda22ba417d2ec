"""Byte-level BPE by the ranks of a public vocabulary file.

Two forms give the same ids. `fold_words` is native: Spark's higher-order functions fold ranked merges over the bytes of distinct
words with a literal rank map. `encode` applies it to the commonest words of the corpus, and gives whole texts their ids in Arrow
batches, where words beyond that table are merged once per task's cache. (Joining all distinct words back to their texts needs more
shuffle than the limits allow; see the README.) `decode` and `digests` are native: binary pieces are put end to end.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import slices

#: Buckets of the literal rank map: a lookup hashes to one, which holds a few pieces.
BUCKETS = 16384
#: Words that the native fold encodes for all tasks: the commonest, by the number of documents that hold them.
COMMON = 32_768
#: Bytes of the longest word among them, so that their table is bounded; longer ones are merged in the batches.
COMMON_BYTES = 256
#: Tasks that fold the common words.
FOLDERS = 16
#: Words that a task's cache holds at most beyond those.
CACHE = 400_000
#: Bytes from which a word's merges use a heap.
LONG = 48


def spelled(pattern: str) -> str:
    """The pattern with white space as the Unicode property, which Java, Python and the vocabulary's own library agree on."""
    parts = regex.split(r"(\\.)", pattern)
    return "".join({r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}.get(p, p) for p in parts)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    return spelled(pattern).replace(r"\p{White_Space}", r"\p{IsWhite_Space}").replace(r"\P{White_Space}", r"\P{IsWhite_Space}")


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of one word (a string column), natively: array<int>.

    Each byte becomes a character, so that pieces are map keys. The state holds the pieces and the rank of each adjacent pair;
    a step merges the leftmost pair of the smallest rank, and none once no pair has a rank.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, r in ranks.items():
        key = piece.decode("latin1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = r
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    none = F.array().cast("array<int>")

    def rank(piece: Column) -> Column:
        return table[(F.crc32(piece) % BUCKETS).cast("int")][piece]

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def start(chars: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: rank(F.concat(chars[i], chars[i + 1])))
        return F.struct(chars.alias("p"), pairs.alias("r"))

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def merge(position: Column) -> Column:
            i = (position - 1).cast("int")

            def put(piece: Column) -> Column:
                left = F.when(i > 0, F.array(rank(F.concat(F.get(p, i - 1), piece)))).otherwise(none)
                right = F.when(position < F.size(r), F.array(rank(F.concat(piece, F.get(p, i + 2))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(p, 1, i), F.array(piece), F.slice(p, i + 3, F.size(p))).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(i - 1, F.lit(0))), left, right, F.slice(r, i + 3, F.size(p))).alias("r"),
                )

            return let(F.concat(p[i], p[i + 1]), put)

        return F.when(F.array_min(r).isNull(), state).otherwise(let(F.array_position(r, F.array_min(r)), merge))

    def merged(chars: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), F.size(chars)), start(chars), step, lambda s: F.transform(s["p"], rank))

    text = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return let(text, lambda t: F.when(rank(t).isNotNull(), F.array(rank(t))).when(F.length(t) == 0, none).otherwise(let(F.split(t, ""), merged)))


def common_words(docs: DataFrame, text: str, pattern: str, most: int) -> DataFrame:
    """The `most` words that the most documents hold, over all documents; a document's repeats are dropped before the shuffle."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(java_pattern(pattern)), F.lit(0)))).alias("word")).filter(F.octet_length("word") <= COMMON_BYTES)
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word")


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word: always the leftmost pair of the smallest rank is merged first."""
    if word in ranks:
        return (ranks[word],)
    if len(word) >= LONG:
        return merge_long(word, ranks)
    find, none = ranks.get, 1 << 60
    parts = [word[i : i + 1] for i in range(len(word))]
    found = [find(word[i : i + 2], none) for i in range(len(word) - 1)]
    while found and (best := min(found)) < none:
        i = found.index(best)
        piece = parts[i] + parts.pop(i + 1)
        parts[i] = piece
        del found[i]
        if i:
            found[i - 1] = find(parts[i - 1] + piece, none)
        if i < len(found):
            found[i] = find(piece + parts[i + 1], none)
    return tuple([ranks[p] for p in parts])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of pairs over linked pieces, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 if none does
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, c = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != c:  # a piece has changed since
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            if (r := ranks.get(word[a : end[c]])) is not None:
                heapq.heappush(heap, (r, a, end[c]))
        if before[a] >= 0 and (r := ranks.get(word[before[a] : c])) is not None:
            heapq.heappush(heap, (r, before[a], c))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return tuple(out)


_CACHES: dict[tuple, dict[str, tuple[int, ...]]] = {}


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """doc_id and ids (array<int>), a row per row.

    Null and empty texts have no ids. Each match of `pattern` is encoded by itself, without special tokens. Only bytes that the vocabulary
    knows can be encoded, else KeyError. Other columns are dropped.
    """
    ranks = read_ranks(path)
    frequent = common_words(docs, text, pattern, common)
    table = {r["word"]: tuple(r["ids"]) for r in frequent.repartition(FOLDERS).select("word", fold_words(F.col("word"), ranks).alias("ids")).collect()}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, table))  # both bounded: by the vocabulary and by `common` words of COMMON_BYTES
    name = (path, pattern, hash(frozenset(table.items())))
    wanted = spelled(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, given = shared.value
        split = regex.compile(wanted)
        cache = _CACHES.setdefault(name, {})
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                flat, sizes = array("i"), [0]
                for t in batch.column("t").to_pylist():
                    words = split.findall(t or "")
                    new = [w for w in set(words) if w not in cache]
                    if len(cache) + len(new) > CACHE:
                        cache.clear()
                        new = set(words)
                    for w in new:
                        cache[w] = given.get(w) or merge_word(w.encode(), known)
                    flat.extend(chain.from_iterable(map(cache.__getitem__, words)))
                    sizes.append(len(flat))
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast({key} as long) k", f"{text} t").mapInArrow(run, "doc_id long, ids array<int>")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Of encode()'s rows: n_tokens, ids_sha256 (of the decimal ids) and decoded_sha256 (of the decoded bytes), natively."""
    ids = F.col("ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(ids, read_ranks(path)), 256).alias("decoded_sha256"),
    )


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids, natively: their binary pieces, from a literal array, end to end. An unknown id gives null."""
    size = max(ranks.values()) + 1
    pieces: list[str | None] = [None] * size
    for piece, r in ranks.items():
        pieces[r] = base64.b64encode(piece).decode()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")
    known = F.transform(ids, lambda i: F.get(table, i).cast("string"))
    return F.when(F.exists(known, lambda p: p.isNull()), None).otherwise(F.array_join(known, "").cast("binary"))
