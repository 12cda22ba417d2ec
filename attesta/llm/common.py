"""Shared helpers: durable intermediates, bounded Arrow slices and vectorised hashes over UTF-8 bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Text bytes that one vectorised step holds at most, apart from a single longer text.
STEP_BYTES = 1 << 20
#: Bytes of one batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Bits of a map of ids, and of one row of it, which is what bitmap_construct_agg makes.
MAP_BITS, MAP_ROW = 1 << 25, 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets one; a cluster raises an error, as
    its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="attesta-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Folders of tables that durable() wrote, by the table's DataFrame.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, batches of rows that go to Python hold at most BATCH_BYTES, or one row: buffers on both sides stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: later plans start there."""
    path = f"{shared_dir(df.sparkSession)}/attesta-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of durable() that no later plan reads."""
    path = _WRITTEN.pop(df, None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def placed(df: DataFrame, *order: Column, dealt_by: int | None = None) -> DataFrame:
    """df with `place`, each row's number from 0 in this order, without sorting all rows in one task.

    Rows are dealt into ranges and sorted within them; a range begins at the count of all rows before it, which is one number a
    range. The order has to name every row, or rows that tie are alike. Ranges are cut by the first `dealt_by` columns of the order, as
    Spark samples these on the driver. The sorted rows are written to the shared folder.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(df.repartitionByRange(parts, *order[:dealt_by]).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("at_", 33).alias("range_")).agg(F.count("*").alias("n_"))
    starts = sizes.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("start_"))
    within = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.withColumn("range_", F.shiftright("at_", 33)).join(F.broadcast(starts), "range_")
    return found.withColumn("place", F.col("start_") + within).drop("at_", "range_", "start_")


def maybe_among(key: Column, rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """rows with `name`: false only where `key` isn't among the whole numbers of ids' one column, so that few rows have to move for a join.

    Hashes of ids set bits of a map of MAP_BITS bits at most, which is broadcast; each other id is taken for one of them with a chance
    of (ids / MAP_BITS) at most. Null keys are among none.
    """
    place = lambda x: F.pmod(F.xxhash64(x.cast("long")), F.lit(MAP_BITS)).cast("int")
    bits = ids.select(place(F.col(ids.columns[0])).alias("at_")).groupBy(F.expr(f"at_ div {MAP_ROW}").alias("row_")).agg(F.expr(f"bitmap_construct_agg(at_ % {MAP_ROW})").alias("bits_"))
    spread = rows.withColumn("at_", F.when(key.isNotNull(), place(key))).withColumn("row_", F.expr(f"at_ div {MAP_ROW}"))
    byte = F.expr(f"cast(conv(hex(substring(bits_, at_ % {MAP_ROW} div 8 + 1, 1)), 16, 10) as int)")
    held = F.getbit(byte, F.col("at_") % 8) == 1
    return spread.join(F.broadcast(bits), "row_", "left").withColumn(name, F.coalesce(held, F.lit(False))).drop("row_", "at_", "bits_")


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo."""
    return F.crc32(F.col(column).cast("string")) % modulus


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose text is about `most` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts by steps() over a column."""
    for a, b in steps(batch.column(column), most):
        yield batch.slice(a, b - a)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one uint8 array, and the bounds of each (one more than there are texts). Null: empty."""
    texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all input bits (a public-domain integer finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed random 64-bit value for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Lower-cases A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def ngram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes from each place, by doubling: the hash of a long run comes from those of its halves."""
    done, factor, h = 1, int(FACTOR), codes
    parts: list[tuple[int, np.ndarray, int]] = [(1, h, factor)]
    while done * 2 <= n:
        h = h[:-done] * np.uint64(factor) + h[done:]
        factor = factor * factor % (1 << 64)
        done *= 2
        parts.append((done, h, factor))
    out, have = h, done
    for size, part, f in reversed(parts[:-1]):
        if have + size <= n:
            out = out[: len(part) - have] * np.uint64(f) + part[have:]
            have += size
    return out[: max(0, len(codes) - n + 1)]


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of `window` values."""
    done = 1
    while done * 2 <= window:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = window - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in packed texts, and the text that each word belongs to. Words never cross texts."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    longest = int(length.max())
    powers = np.ones(longest + 1, np.uint64)
    np.multiply.accumulate(np.full(longest, FACTOR, np.uint64), out=powers[1:])
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    at = np.repeat(starts, length) + offset
    total = np.add.reduceat(BYTE_CODE[data[at]] * powers[offset], np.cumsum(length) - length)
    return mix(total + length.astype(np.uint64))
