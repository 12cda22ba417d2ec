"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import hashed
from attesta.llm.common import crc_mod, packed, slices
from attesta.llm.sample import by_class, labelled_texts

SIZES, BITS, DIM = (2, 3, 4), 16, 16
#: Labelled texts of each language that training takes at most.
SAMPLE = 600
EPOCHS, BATCH, RATE = 6, 32, 4.0
#: Pieces from anywhere in a text that training adds to the whole text, so that short texts are seen; bytes each.
PIECES = (24, 80, 300)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bucket by language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[bytes, str]], seed: int = 3) -> LanguageModel | None:
    """Stochastic gradient descent on cross-entropy; a tenth of the rows sets temperature and rejection threshold. No rows: None."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    number = {y: i for i, y in enumerate(languages)}
    held = rng.random(len(rows)) < 0.1
    pieces = []
    for (t, y), h in zip(rows, held, strict=True):
        cut = [t]
        for n in PIECES:
            if len(t) > n:
                a = int(rng.integers(0, len(t) - n))
                cut.append(t[a : a + n])
        pieces += [(c, number[y], h) for c in cut if len(c) >= max(SIZES)]
    features = [hashed.counted(t, SIZES, BITS) for t, _, _ in pieces]
    truth = np.array([y for _, y, _ in pieces], np.int64)
    apart = np.array([h for _, _, h in pieces], bool)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~apart)
    total, done = max(1, EPOCHS * len(learn)), 0
    for _ in range(EPOCHS):
        for chosen in hashed.batches(learn, BATCH, rng):
            some = learn[chosen]
            rate = RATE * (1 - done / total)
            buckets = np.concatenate([features[i][0] for i in some])
            share = np.concatenate([features[i][1] for i in some])
            cuts = np.cumsum([0] + [len(features[i][0]) for i in some])
            mean = np.add.reduceat(embed[buckets] * share[:, None], cuts[:-1], axis=0)
            error = soft(mean @ out + bias)
            error[np.arange(len(some)), truth[some]] -= 1
            back = np.repeat(error @ out.T, np.diff(cuts), axis=0) * share[:, None]
            out -= rate / len(some) * (mean.T @ error)
            bias -= rate / len(some) * error.sum(0)
            np.subtract.at(embed, buckets, rate * back * 4)
            done += len(some)
    weights = embed @ out
    check = np.flatnonzero(apart) if apart.any() else learn
    logits = np.stack([features[i][1] @ weights[features[i][0]] for i in check]) + bias if len(check) else np.zeros((0, len(languages)))
    scales = np.geomspace(0.1, 4, 40)
    loss = [-np.log(np.maximum(1e-12, soft(logits / t)[np.arange(len(check)), truth[check]])).sum() for t in scales]
    best = float(scales[int(np.argmin(loss))]) if len(check) else 1.0
    sure = soft(logits / best).max(1) if len(check) else np.ones(1)
    right = sure[soft(logits / best).argmax(1) == truth[check]] if len(check) else sure
    return LanguageModel(languages, weights.astype(np.float32), bias, best, float(np.quantile(right, 0.005)) if len(right) else 0.0)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability, 0 to 1) and rejected (the score is below the threshold), a row per row.

    Whole texts count. Null texts and texts without a letter give `und` with score 0; texts shorter than a subword get the
    model's bias. A model without languages gives `und` everywhere. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                if model is None:
                    name, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    data, bounds = packed(batch.column("t"))
                    total, count = hashed.sums(data, bounds, model.weights, SIZES)
                    p = soft((total / np.maximum(1, count)[:, None] + model.bias) / model.temperature)
                    name, score = [model.languages[i] for i in p.argmax(1)], p.max(1)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("letters"), pa.array(name), pa.array(score)], names=["doc_id", "letters", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(run, "doc_id long, letters boolean, lang_pred string, score double")
    limit = model.threshold if model else 1.0
    return found.select(
        "doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), (~F.col("letters") | (F.col("score") < limit)).alias("rejected"),
    )


def learn_languages(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", modulus: int = 5, held_out: int = 0, most: int = SAMPLE) -> LanguageModel | None:
    """Train on at most `most` texts of each language, from rows whose crc32(key) mod `modulus` is not `held_out`."""
    known = docs.filter((crc_mod(key, modulus) != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = by_class(known.select(key, lang), lang, key, most)
    return train(labelled_texts(docs, sample, key, text, lang))
