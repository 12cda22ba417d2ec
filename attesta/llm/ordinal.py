"""Quality classifier: cumulative-link regression of graded ratings on hashed text, with one weight vector for all thresholds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import hashed
from attesta.llm.common import packed, slices
from attesta.llm.sample import by_class, labelled_texts

SIZES, BITS = (3, 5), 17
STYLE_BITS = 10
#: Labelled texts of each grade that training takes at most.
SAMPLE = 1500
EPOCHS, BATCH, RATE = 8, 32, 0.5
#: A text is kept if its probability of a grade of 1 or more reaches this.
KEEP = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>!"))
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)
BREAKS = np.isin(np.arange(256), list(b" \n\t"))


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray  # one for each bucket of an n-gram
    style: np.ndarray  # one for each bucket of a style token
    thresholds: np.ndarray  # ascending, one fewer than grades


def style_tokens(text: bytes) -> list[int]:
    """Hashed tokens for how well a text compresses, its shares of words equal to the one before, of symbols, capitals, digits and
    breaks, each by its bin."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, len(data))
    packed_size = sum(len(zlib.compress(text[i : i + (1 << 20)], 1)) for i in range(0, len(text), 1 << 20))
    words = text.split()
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    shares = [packed_size / (n + 60), again, *(float(m[data].sum()) / n for m in (SYMBOLS, CAPITALS, DIGITS, BREAKS))]
    tokens = [b"%d:%d" % (k, min(24, int(s * 40))) for k, s in enumerate(shares)] + [b"size:%d" % int(np.log2(n))]
    return [zlib.crc32(t) % (1 << STYLE_BITS) for t in tokens]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[bytes, int]], seed: int = 5) -> OrdinalModel | None:
    """Adaptive gradient descent on the proportional-odds likelihood. Thresholds stay ordered: each is the one before plus a positive gap."""
    grades = sorted({int(y) for _, y in rows})
    if len(grades) < 2:
        return None
    rng = np.random.default_rng(seed)
    truth = np.searchsorted(grades, [y for _, y in rows])
    # all texts' features in two arrays, which go back to the system as a whole; only what is written of them takes memory
    most = len(SIZES) * sum(len(t) for t, _ in rows)
    all_buckets, all_shares, cut = np.empty(most, np.int32), np.empty(most, np.float32), np.zeros(len(rows) + 1, np.int64)
    for i, (t, _) in enumerate(rows):
        found, part = hashed.counted(t, SIZES, BITS)
        cut[i + 1] = cut[i] + len(found)
        all_buckets[cut[i] : cut[i + 1]], all_shares[cut[i] : cut[i + 1]] = found, part
        del found, part
    style = [style_tokens(t) for t, _ in rows]
    levels = len(grades) - 1
    weight, square = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-8, np.float32)
    extra, extra_square = np.zeros(1 << STYLE_BITS, np.float32), np.full(1 << STYLE_BITS, 1e-8, np.float32)
    gaps = np.zeros(levels)  # the first threshold, then logarithms of gaps
    counts = np.bincount(truth, minlength=len(grades))
    below = np.clip(np.cumsum(counts)[:-1] / counts.sum(), 0.01, 0.99)
    start = np.log(below / (1 - below))
    gaps[0] = start[0]
    gaps[1:] = np.log(np.maximum(0.1, np.diff(start)))
    for _ in range(EPOCHS):
        for some in hashed.batches(rows, BATCH, rng):
            cuts = np.cumsum(np.r_[0, np.diff(cut)[some]])
            buckets, share = (np.concatenate([x[cut[i] : cut[i + 1]] for i in some]) for x in (all_buckets, all_shares))
            f = hashed.text_sums(weight[buckets] * share, cuts)
            f = f + np.array([extra[style[i]].sum() for i in some])
            theta = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
            c = np.c_[np.zeros(len(some)), sigmoid(theta[None, :] - f[:, None]), np.ones(len(some))]
            y = truth[some]
            row = np.arange(len(some))
            p = np.maximum(1e-9, c[row, y + 1] - c[row, y])
            slope = c * (1 - c)
            d_f = (slope[row, y + 1] - slope[row, y]) / p  # of the negative log-likelihood
            d_theta = np.zeros((len(some), levels))
            upper, lower = y < levels, y > 0
            d_theta[row[upper], y[upper]] -= (slope[row, y + 1] / p)[upper]
            d_theta[row[lower], y[lower] - 1] += (slope[row, y] / p)[lower]
            g_theta = d_theta.mean(0)
            tail = np.cumsum(g_theta[::-1])[::-1]
            gaps -= 0.1 * np.r_[tail[0], tail[1:] * np.exp(gaps[1:])]
            grad = np.repeat(d_f, np.diff(cuts)) * share / len(some)
            np.add.at(square, buckets, grad * grad)
            np.subtract.at(weight, buckets, RATE * grad / np.sqrt(square[buckets]))
            for i, g in zip(some, d_f / len(some), strict=True):
                np.add.at(extra_square, style[i], g * g)
                np.subtract.at(extra, style[i], 0.1 * g / np.sqrt(extra_square[style[i]]))
    return OrdinalModel(grades, weight, extra, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]))


def grade(docs: DataFrame, model: OrdinalModel | None, text: str = "text", key: str = "doc_id", keep: float = KEEP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, expected_grade, tail (probability of a grade above the lowest), the columns in `carry` and kept, a row per row.

    Whole texts count; null and empty texts have no n-grams and are judged by style and thresholds. Without a model (fewer than
    two grades to learn from) everything is kept with null grades. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                others = batch.columns[2:]
                if model is None:
                    yield pa.RecordBatch.from_arrays([batch.column("k"), *[pa.nulls(batch.num_rows, pa.float64())] * 2, *others], names=names)
                    continue
                data, bounds = packed(batch.column("t"))
                total, count = hashed.sums(data, bounds, model.weights[:, None], SIZES)
                extra = [model.style[style_tokens(data[a:b].tobytes())].sum() for a, b in zip(bounds, bounds[1:], strict=False)]
                f = total[:, 0] / np.maximum(1, count) + np.array(extra)
                above = 1 - sigmoid(model.thresholds[None, :] - f[:, None])
                steps = np.diff(np.array(model.grades, float))
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.grades[0] + above @ steps), pa.array(above[:, 0]), *others], names=names)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    names = ["doc_id", "expected_grade", "tail", *carry]
    kinds = ["long", "double", "double", *(docs.schema[c].dataType.simpleString() for c in carry)]
    found = rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    return found.withColumn("kept", F.coalesce(F.col("tail") >= keep, F.lit(True)))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and grade: 0 for low quality, 1 for good but toxic, 2 for good. Rows without a quality are left out."""
    value = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.filter("quality is not null").groupBy(key).agg(F.min(value).alias("grade"))


def learn_grades(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> OrdinalModel | None:
    """Train on at most `most` texts of each grade; ratings: key, grade."""
    return train(labelled_texts(docs, by_class(ratings, "grade", key, most), key, text, "grade"))
