"""Removal of repeated passages: stretches that may repeat meet in blocks, whose suffix arrays decide.

A stretch is a maximal run of SPAN-byte windows that have the same smallest ANCHOR-byte hash. A window's smallest hash depends on
its own bytes only, so equal windows always lie in stretches of the same hash:

1. Each task cuts its texts into stretches and sends, packed, (hash of the window minimum, hash of the stretch, document).
   Equal stretches of one task are sent once, for the smallest document; the others are known to be repeats there and then.
2. By window hash: all but the first document of a stretch are repeats. Where different stretches meet, the first document
   of each has to send its bytes.
3. Those bytes meet in blocks by window hash. A two-stage suffix array and its adjacent common prefixes find windows that start
   in several stretches, and with them the smallest document of each.
4. Each document removes what is covered.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BYTE_CODE, FACTOR, durable, mix, ngram_hash, packed, sliding_min, steps
from attesta.llm.suffix_array import DEPTH, Block, adjacent_prefixes, suffix_array

SPAN = 50
ANCHOR = 16
#: Windows that a stretch holds at most: text of one repeated letter is cut there.
LONGEST = 4096
#: Text bytes whose stretches one packed message gathers, that one document group holds, and that one hash range stands for.
MESSAGE, GROUP, RANGE = 16 << 20, 4 << 20, 16 << 20
#: Blocks of stretches for each hash range.
FINER = 8
#: Bytes kept of a window hash, a stretch hash, a document id and a place.
WINDOW_BYTES, STRETCH_BYTES, DOC_BYTES, PLACE_BYTES = 6, 7, 8, 5
NO_ID = (1 << 63) - 1
CARRIED = "carried_"


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0 to n, and of its inverse modulo 2^64."""
    inverse = pow(int(FACTOR), -1, 1 << 64)
    out = []
    for base in (int(FACTOR), inverse):
        p = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, base, np.uint64), out=p[1:])
        out.append(p)
    return out[0], out[1]


def stretches(data: np.ndarray, bounds: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed texts: each stretch's first window, its end (after its last window), window hash, own hash, and text number."""
    n = len(data)
    if n < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    low = sliding_min(mix(ngram_hash(BYTE_CODE[data], ANCHOR)), span - ANCHOR + 1)
    lengths = np.diff(bounds)
    valid = np.repeat(bounds[1:], lengths) - np.arange(n) >= span
    valid = valid[: len(low)]
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(fresh)
    stops = np.flatnonzero(valid & ~np.r_[valid[1:], False]) + 1
    ends = np.minimum(stops[np.searchsorted(stops, starts, side="right")], np.r_[starts[1:], n])
    if len(starts) and (ends - starts).max() > LONGEST:
        pieces = -(-(ends - starts) // LONGEST)
        offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
        ends, starts = np.repeat(ends, pieces), np.repeat(starts, pieces) + offset
        ends = np.minimum(ends, starts + LONGEST)
    window = mix(low[starts] ^ np.uint64(0x5851F42D4C957F2D))
    up, down = powers(max(n, 1 << 20))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=total[1:])
    own = mix((total[ends + span - 1] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, window, own & np.uint64((1 << 8 * STRETCH_BYTES) - 1), np.searchsorted(bounds, starts, side="right") - 1


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Equally long columns, each by its lowest bytes, byte planes in turn: empty planes compress to nothing."""
    n = len(columns[0][0])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c.astype(np.int64, copy=False)).view(np.uint8).reshape(n, 8)[:, :k].T.tobytes() if c.dtype != np.uint64 else np.ascontiguousarray(c).view(np.uint8).reshape(n, 8)[:, :k].T.tobytes() for c, k in columns)


def unpack(blob: bytes, kinds: list[int]) -> tuple[list[np.ndarray], bytes]:
    """Columns of pack(), as int64 where all eight bytes were kept, else uint64; and what follows them."""
    n = int.from_bytes(blob[:8], "little")
    at, out = 8, []
    for k in kinds:
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
        out.append(planes.reshape(-1).view(np.int64 if k == 8 else np.uint64))
        at += n * k
    return out, blob[at:]


def unpack_all(blobs: list[bytes], kinds: list[int]) -> list[np.ndarray]:
    parts = [unpack(b, kinds)[0] for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64 if k == 8 else np.uint64) for k in kinds]


def groups_of(docs: np.ndarray, n: int) -> np.ndarray:
    """The group of each document id: crc32 of its decimal text, modulo n, as Spark computes it."""
    ids, back = np.unique(docs, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % i) % n for i in ids.tolist()], np.int64)[back]


def split_by(key: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, bytes]]:
    """The packed rows of each value of key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    columns = [(c[order], k) for c, k in columns]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(key[a]), pack([(c[a:b], k) for c, k in columns])


MESSAGES = "kind int, place int, blob binary"
COVERED, SEARCH, ASKED, FOUND = 0, 1, 2, 3
TO_DOC, TO_SEARCH = [STRETCH_BYTES, DOC_BYTES], [WINDOW_BYTES, STRETCH_BYTES, DOC_BYTES]


def table_of(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds, places, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "place": pa.array(places, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def scan_messages(ranges: int, groups: int, span: int):
    """Step 1: packed messages of a task's texts."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> list[tuple[int, int, bytes]]:
        window, own, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, own, window))
        window, own, doc = window[order], own[order], doc[order]
        first = np.r_[True, (window[1:] != window[:-1]) | (own[1:] != own[:-1])]
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        later = doc > least
        rows = [(SEARCH, k, b) for k, b in split_by((window[first] % np.uint64(ranges)).astype(np.int64), [(window[first] >> np.uint64(16), WINDOW_BYTES), (own[first], STRETCH_BYTES), (doc[first], DOC_BYTES)])]
        rows += [(COVERED, k, b) for k, b in split_by(groups_of(doc[later], groups), [(own[later], STRETCH_BYTES), (doc[later], DOC_BYTES)])]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in steps(batch.column("t")):
                part = batch.slice(a, b - a)
                data, bounds = packed(part.column("t"))
                _, _, window, own, text = stretches(data, bounds, span)
                if len(text):
                    held.append((window, own, part.column("k").to_numpy()[text]))
                size += len(data)
                if size >= MESSAGE and held:
                    yield from table_of(flush(held)).to_batches()
                    held, size = [], 0
        if held:
            yield from table_of(flush(held)).to_batches()

    return run


def search(groups: int):
    """Step 2: what the stretches of one hash range tell their documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, place = key[0].as_py(), key[1].as_py()
        blobs = table.column("blob").to_pylist()
        if kind == COVERED:
            return table_of([(COVERED, place, b) for b in blobs])
        window, own, doc = unpack_all(blobs, TO_SEARCH)
        order = np.argsort(window, kind="stable")
        sorted_window = window[order]
        same = sorted_window[1:] == sorted_window[:-1]
        several = order[np.r_[False, same] | np.r_[same, False]]
        window, own, doc = window[several], own[several], doc[several]
        order = np.lexsort((doc, own, window))
        window, own, doc = window[order], own[order], doc[order]
        if not len(doc):
            return table_of([])
        first = np.r_[True, (window[1:] != window[:-1]) | (own[1:] != own[:-1])]
        at = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
        later = doc > doc[at]
        rows = [(COVERED, k, b) for k, b in split_by(groups_of(doc[later], groups), [(own[later], STRETCH_BYTES), (doc[later], DOC_BYTES)])]
        window, own, doc = window[first], own[first], doc[first]
        cuts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        size = np.diff(np.r_[cuts, len(window)])
        differ = np.minimum.reduceat(doc, cuts) < np.maximum.reduceat(doc, cuts)
        asked = np.repeat((size > 1) & differ, size)
        rows += [(ASKED, k, b) for k, b in split_by(groups_of(doc[asked], groups), [(own[asked], STRETCH_BYTES), (doc[asked], DOC_BYTES)])]
        return table_of(rows)

    return run


def tag(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(own + mix(doc.astype(np.int64).view(np.uint64)))


def texts_in_steps(table: pa.Table, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Packed texts of a document group, their ids and the number of the first, about a MB at a time. wanted: ids; others are skipped."""
    table = table.combine_chunks()
    if wanted is not None:
        table = table.filter(pa.array(np.isin(table.column("k").to_numpy(), wanted)))
    texts = table.column("t")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ids = table.column("k").to_numpy()
    for a, b in steps(texts):
        data, bounds = packed(texts.slice(a, b - a))
        yield data, bounds, ids[a:b], a


def send_stretches(blocks: int, span: int):
    """Step 3, first half: the bytes of the stretches that a document group is asked for."""

    def run(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        asked = [b for k, b in zip(messages.column("kind").to_pylist(), messages.column("blob").to_pylist(), strict=True) if k == ASKED]
        own, doc = unpack_all(asked, TO_DOC)
        if not len(doc) or not docs.num_rows:
            return table_of([])
        wanted = np.unique(tag(own, doc))
        rows, sent = [], np.zeros(0, np.uint64)
        for data, bounds, ids, _ in texts_in_steps(docs, np.unique(doc)):
            start, end, window, own, text = stretches(data, bounds, span)
            tags = tag(own, ids[text])
            some = np.flatnonzero(np.isin(tags, wanted) & ~np.isin(tags, sent))
            _, once = np.unique(tags[some], return_index=True)
            some = some[once]
            sent = np.concatenate([sent, tags[some]])
            block = (window[some] % np.uint64(blocks)).astype(np.int64)
            for k in np.unique(block):
                mine = some[block == k]
                length = end[mine] - start[mine] + span - 1
                at = np.repeat(start[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
                rows.append((SEARCH, int(k), pack([(own[mine], STRETCH_BYTES), (ids[text[mine]], DOC_BYTES), (length, PLACE_BYTES)]) + data[at].tobytes()))
        return table_of(rows)

    return run


def compare(groups: int, span: int):
    """Step 3, second half: the windows of a block's stretches that start in a smaller document, by the block's suffix array."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(b, [STRETCH_BYTES, DOC_BYTES, PLACE_BYTES]) for b in table.column("blob").to_pylist()]
        own, doc, length = (np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True))
        length = length.astype(np.int64)
        block = Block(np.frombuffer(b"".join(p[1] for p in parts), np.uint8), length)
        order = suffix_array(block, max(DEPTH, span))
        common = adjacent_prefixes(block, order, span, span)
        run_starts = np.flatnonzero(common < span)
        number = np.repeat(np.arange(len(length)), length + 1)
        docs = doc[number[order]]
        least = np.repeat(np.minimum.reduceat(docs, run_starts), np.diff(np.r_[run_starts, len(order)]))
        hit = np.zeros(len(order) + 1, bool)
        hit[order[(least < docs) & (block.left[order] >= span)]] = True
        first = np.flatnonzero(hit[:-1] & ~np.r_[False, hit[:-2]])
        last = np.flatnonzero(hit[:-1] & ~hit[1:]) + 1
        of = number[first]
        base = np.cumsum(length + 1) - length - 1
        rows = [(FOUND, k, b) for k, b in split_by(groups_of(doc[of], groups), [(own[of], STRETCH_BYTES), (doc[of], DOC_BYTES), (first - base[of], PLACE_BYTES), (last - base[of], PLACE_BYTES)])]
        return table_of(rows)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first:long,last:long>>, kept binary, kept_text string"
RESULT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary()), ("kept_text", pa.string()),
])


def remove(span: int, keep: bool):
    """Step 4: each document without what is covered."""

    def run(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        kinds, blobs = messages.column("kind").to_pylist(), messages.column("blob").to_pylist()
        covered = np.unique(tag(*unpack_all([b for k, b in zip(kinds, blobs, strict=True) if k == COVERED], TO_DOC)))
        own, doc, first, last = unpack_all([b for k, b in zip(kinds, blobs, strict=True) if k == FOUND], [STRETCH_BYTES, DOC_BYTES, PLACE_BYTES, PLACE_BYTES])
        found = tag(own, doc)
        order = np.argsort(found, kind="stable")
        found, first, last = found[order], first[order].astype(np.int64), last[order].astype(np.int64)
        out = []
        for data, bounds, ids, _ in texts_in_steps(docs):
            start, end, _, own, text = stretches(data, bounds, span)
            tags = tag(own, ids[text])
            change = np.zeros(len(data) + 1, np.int32)
            whole = np.isin(tags, covered)
            np.add.at(change, start[whole], 1)
            np.add.at(change, end[whole] + span - 1, -1)
            lo, hi = np.searchsorted(found, tags, "left"), np.searchsorted(found, tags, "right")
            n = hi - lo
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            base = np.repeat(start, n)
            np.add.at(change, base + first[which], 1)
            np.add.at(change, base + last[which] + span - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i in range(len(ids)):
                a, b = bounds[i], bounds[i + 1]
                mask = gone[a:b]
                if mask.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                    spans = [{"first": int(x), "last": int(y)} for x, y in edge.reshape(-1, 2)]
                    rest = data[a:b][~mask].tobytes()
                    left = np.flatnonzero(np.diff(np.r_[False, ~mask, False].astype(np.int8))).reshape(-1, 2)
                else:
                    spans, rest, left = [], data[a:b].tobytes(), [(0, b - a)]
                pieces = "".join(data[a + x : a + y].tobytes().decode("utf-8", "ignore") for x, y in left) if keep else None
                out.append((None if ids[i] == NO_ID else int(ids[i]), int(b - a), int(mask.sum()), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest if keep else None, pieces))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(RESULT_SCHEMA), RESULT_SCHEMA, strict=True)]
        others = [(n, docs.column(n)) for n in docs.column_names if n.startswith(CARRIED)]
        return pa.table(columns + [c for _, c in others], names=[*RESULT_SCHEMA.names, *(n.removeprefix(CARRIED) for n, _ in others)])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, keep: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges), kept (bytes) and
    kept_text (the same without characters that were cut); the last two are null unless `keep`. Then the columns named in `carry`.

    A byte goes if a `span`-byte string that covers it also starts in a document with a smaller doc_id, judged on the input; matches
    never cross documents. Null and empty texts, and texts under `span` bytes, lose nothing. Rows that share a doc_id are one
    document in comparisons and keep their rows; a null doc_id counts as the largest. Other columns are dropped.
    """
    if span < ANCHOR:
        raise ValueError(f"span must be {ANCHOR} or more")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text).alias("t"), *(F.col(c).alias(CARRIED + c) for c in carry))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges, groups = int(max(1, total // RANGE)), int(max(1, total // GROUP))
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, groups = max(ranges, wide), max(groups, wide)
    blocks = ranges * (FINER if total > RANGE else 1)
    sent = rows.select("k", "t").mapInArrow(scan_messages(ranges, groups, span), MESSAGES)
    told = durable(sent.groupBy("kind", "place").applyInArrow(search(groups), MESSAGES))
    dealt = rows.withColumn("place", (F.crc32(F.col("k").cast("string")) % groups).cast("int"))
    asked = dealt.groupBy("place").cogroup(told.filter(f"kind = {ASKED}").groupBy("place")).applyInArrow(send_stretches(blocks, span), MESSAGES)
    found = asked.groupBy("place").applyInArrow(compare(groups, span), MESSAGES)
    known = told.filter(f"kind = {COVERED}").unionByName(found)
    return dealt.groupBy("place").cogroup(known.groupBy("place")).applyInArrow(remove(span, keep), ", ".join([RESULT, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)]))
