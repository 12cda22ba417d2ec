"""Bounded, repeatable samples of labelled rows for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of one text that a training sample takes: of a longer text, so many from a place that its key's hash chooses. Scoring has no limit.
LONGEST = 200_000
#: Bytes of all texts of a sample, shared evenly by its classes; each class has one text at least.
MOST_BYTES = 64 << 20
#: Hash shares of a class that are cut first, each by itself, so that no class is sorted in one task.
SHARES = 64
#: Sampled keys that are broadcast at most; more are joined.
BROADCAST_ROWS = 500_000


def hashed(key: str) -> Column:
    return F.xxhash64(F.lit(17), key)


def by_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """label and key of at most `most` rows of each value of label: the ones with the smallest hashes of key. All values are taken.

    Rows with a null label are left out. The sample depends on the rows only, not on their order or partitions.
    """
    rows = rows.filter(F.col(label).isNotNull()).select(label, key)
    share = Window.partitionBy(label, F.pmod(hashed(key), F.lit(SHARES))).orderBy(hashed(key), key)
    whole = Window.partitionBy(label).orderBy(hashed(key), key)
    first = rows.withColumn("rank_", F.row_number().over(share)).filter(F.col("rank_") <= most)
    return first.withColumn("rank_", F.row_number().over(whole)).filter(F.col("rank_") <= most).drop("rank_")


def labelled_texts(docs: DataFrame, sample: DataFrame, key: str, text: str, label: str, most_bytes: int = MOST_BYTES) -> list[tuple[bytes, object]]:
    """Texts and labels of a sample (key, label), in order of key. Null texts are left out.

    Of each class, texts are taken in order of their keys' hashes until their bytes reach its share of `most_bytes`, so what the
    driver gets is bounded by that and by LONGEST for each class."""
    sample = sample.select(key, label)
    rows, classes = sample.agg(F.count("*"), F.count_distinct(label)).first()
    if rows <= BROADCAST_ROWS:
        sample = F.broadcast(sample)
    chars = LONGEST // 4
    place = F.pmod(hashed(key), F.greatest(F.lit(1), F.char_length(text) - chars)).cast("int") + 1
    part = F.when(F.octet_length(text) <= LONGEST, F.col(text)).otherwise(F.substring(F.col(text), place, F.lit(chars)))
    picked = docs.select(F.col(key), part.alias(text)).filter(F.col(text).isNotNull()).join(sample, key)
    order = Window.partitionBy(label).orderBy(hashed(key), key, text)
    sized = picked.withColumn("n_", F.row_number().over(order)).withColumn("bytes_", F.sum(F.octet_length(text)).over(order))
    taken = sized.filter((F.col("n_") == 1) | (F.col("bytes_") <= most_bytes // max(1, classes)))
    return [((t or "").encode(), y) for _, t, y in sorted(taken.select(key, text, label).collect(), key=lambda r: (r[0], r[1] or ""))]
