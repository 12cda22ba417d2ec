"""Hashed byte n-grams of texts: feature indices, and sums of per-bucket weights over whole texts."""

from __future__ import annotations

import numpy as np

from attesta.llm.common import BYTE_CODE, LOWER, SPACE, mix, ngram_hash

#: Text bytes that one step of a sum works on; longer texts are summed in such steps, with an overlap.
STEP = 1 << 18


def gram_indices(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each size, the bucket of the n-gram from each byte; letters lower-cased, white space made equal."""
    data = np.where(SPACE[data], np.uint8(32), LOWER[data])
    codes = BYTE_CODE[data]
    return [(mix(ngram_hash(codes, n) + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32) for n in sizes]


def sums(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each packed text, the sum of weights (bucket by output) over its n-grams, and how many n-grams it has."""
    bits = int(weights.shape[0]).bit_length() - 1
    total = np.zeros((len(bounds) - 1, weights.shape[1]))
    count = np.zeros(len(bounds) - 1, np.int64)
    for n in sizes:
        count += np.maximum(0, np.diff(bounds) - n + 1)
    for lo in range(0, len(data), STEP):
        hi = min(len(data), lo + STEP)
        part = data[lo : min(len(data), hi + max(sizes) - 1)]
        texts = np.arange(np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi, side="left"))
        for n, index in zip(sizes, gram_indices(part, sizes, bits), strict=True):
            ends = np.minimum(np.minimum(bounds[texts + 1] - n + 1, hi), lo + len(index)) - lo
            starts = np.maximum(bounds[texts], lo) - lo
            for k in range(weights.shape[1]):
                running = np.zeros(len(index) + 1)
                np.cumsum(weights[index, k], out=running[1:], dtype=np.float64)
                a, b = np.minimum(starts, len(index)), np.clip(ends, 0, len(index))
                total[texts, k] += np.where(b > a, running[b] - running[a], 0)
    return total, count


def counted(text: bytes, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text with their shares of all its n-grams."""
    found = np.concatenate(gram_indices(np.frombuffer(text, np.uint8), sizes, bits))
    buckets, n = np.unique(found, return_counts=True)
    return buckets, (n / max(1, n.sum())).astype(np.float32)


def text_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sum of each text's values, which end where the next text's begin; 0 for a text without n-grams, wherever it stands."""
    total = np.zeros(len(cuts) - 1, values.dtype)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        total[some] = np.add.reduceat(values, cuts[some])
    return total


def batches(rows: list, size: int, rng: np.random.Generator):
    order = rng.permutation(len(rows))
    for i in range(0, len(order), size):
        yield order[i : i + size]
