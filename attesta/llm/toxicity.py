"""Toxicity: a subsequence string kernel with Nystroem landmarks under a linear support vector machine.

Texts become streams of letters, white space and parts of other letters; digits and punctuation fall out, and so do blanks between
single letters, so characters inserted into a word, or blanks between its letters, don't hide it. The kernel of two strings sums, over all sequences of ORDER symbols within SPAN, the product of their
weights DECAY^gaps. The machine is linear in the landmarks' kernel values and the kernel is linear in the sequences, so a trained
model is one table of sequence weights. A text is scored by the windows of its worst stretches, TOP of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BYTE_CODE, ngram_hash, packed, slices
from attesta.llm.sample import by_class, labelled_texts

ORDER, SPAN, DECAY = 4, 7, 0.6
#: Places that a window's sequences start from.
WINDOW = 12
#: Labelled texts of each class that training takes at most; negatives are taken twice as often.
SAMPLE = 1200
LANDMARKS, COVER = 128, 4
GRAMS = (5, 7, 8, 9)
#: A text's stretches of SEGMENT symbols each give their worst window; the TOP worst of these count.
SEGMENT, TOP = 32, 3
BITS = 5
#: Zeros after each text, so that no window sees the next one; symbols that one step of training or scoring works on.
GAP, PART = SPAN + WINDOW, 1 << 18
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
BLANK = 27
SYMBOL[[9, 10, 11, 12, 13, 32]] = BLANK
SYMBOL[128:] = 28 + np.arange(128) % 4
#: The places of a sequence's second to last symbol after its first, and the weight of its gaps.
SHAPES = [(c, DECAY ** (c[-1] - ORDER + 1)) for c in combinations(range(1, SPAN), ORDER - 1)]


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each sequence of symbols
    bias: float
    slopes: np.ndarray  # one for each of the TOP margins
    offset: float


def spaced(symbols: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of the places `at` of symbols, those of blanks that stand between two words of one letter each."""
    text = np.searchsorted(bounds, at, side="right")
    letter = symbols[at] != BLANK

    def beside(k: int) -> np.ndarray:
        """Whether the symbol k places on is a letter of the same text."""
        out = np.zeros(len(at), bool)
        if k > 0:
            out[:-k] = letter[k:] & (text[k:] == text[:-k])
        else:
            out[-k:] = letter[:k] & (text[:k] == text[-k:])
        return out

    return at[~letter & beside(-1) & ~beside(-2) & beside(1) & ~beside(2)] if len(at) > 2 else at[:0]


def stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of packed texts, GAP zeros after each text, and where each text's symbols start."""
    symbols = SYMBOL[data]
    real = symbols > 0
    real[spaced(symbols, np.flatnonzero(real), bounds)] = False
    before = np.concatenate([[0], np.cumsum(real)])
    size = before[bounds[1:]] - before[bounds[:-1]]
    starts = np.concatenate([[0], np.cumsum(size + GAP)])
    out = np.zeros(starts[-1] + GAP, np.uint8)
    at = np.flatnonzero(real)
    out[np.arange(len(at)) + np.repeat(np.arange(len(size)) * GAP, size)] = symbols[at]
    return out, starts


def parts(starts: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` symbols; a longer text stands alone."""
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
        yield i, j
        i = j


def codes_from(symbols: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape, the code of the sequence from each of the first `places` places of the last axis, and its weight."""
    s = symbols.astype(np.int32)
    pair = {gap: (s[..., : s.shape[-1] - gap] << BITS) | s[..., gap:] for gap in range(1, SPAN)}
    for (a, b, c), weight in SHAPES:
        yield (pair[a][..., :places] << (2 * BITS)) | pair[c - b][..., b : b + places], weight


def clean(codes: np.ndarray) -> np.ndarray:
    """True where none of a code's symbols is 0."""
    mask = (1 << BITS) - 1
    ok = codes & mask > 0
    for k in range(1, ORDER):
        ok &= (codes >> (BITS * k)) & mask > 0
    return ok


def window_sums(symbols: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """The sum of the weights of all sequences from each window of a stream, plus bias."""
    n = len(symbols) - SPAN
    total = np.zeros(n, np.float32)
    for codes, weight in codes_from(symbols, n):
        total += model.table[codes] * np.float32(weight)
    running = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    return (running[WINDOW:] - running[:-WINDOW] + model.bias).astype(np.float32)


def margins(symbols: np.ndarray, starts: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """Text by TOP: the largest window sums of each text's stretches, clipped to [-2, 3]; -2 where it has fewer stretches."""
    out = np.full((len(starts) - 1, TOP), -2.0)
    for i, j in parts(starts):
        a, b = starts[i], starts[j]
        window = window_sums(symbols[a : b + GAP], model)[: b - a]
        window[symbols[a:b] == 0] = -2
        first = starts[i : j + 1] - a
        pieces = -(-np.diff(first) // SEGMENT)
        text = np.repeat(np.arange(j - i), pieces)
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        best = np.maximum.reduceat(window, first[:-1][text] + rank * SEGMENT)
        order = np.lexsort((-best, text))
        out[i + text[order][rank < TOP], rank[rank < TOP]] = np.clip(best[order][rank < TOP], -2, 3)
    return out


class Landmarks:
    """Landmark strings, their sequences, and kernels against them."""

    def __init__(self, strings: list[np.ndarray]):
        found: list[dict[int, float]] = []
        for s in strings:
            padded = np.concatenate([s, np.zeros(SPAN, np.uint8)])
            weights: dict[int, float] = {}
            for codes, weight in codes_from(padded, len(s)):
                for c in codes[clean(codes)].tolist():
                    weights[c] = weights.get(c, 0.0) + weight
            found.append(weights)
        self.codes = np.array(sorted(set().union(*found)), np.int64)
        row = {c: i for i, c in enumerate(self.codes.tolist())}
        self.matrix = np.zeros((len(self.codes) + 1, len(strings)))
        for j, weights in enumerate(found):
            for c, v in weights.items():
                self.matrix[row[c], j] = v
        self.matrix /= np.maximum(1e-9, np.sqrt((self.matrix**2).sum(0)))
        self.row = np.full(1 << (BITS * ORDER), len(self.codes), np.int32)
        self.row[self.codes] = np.arange(len(self.codes))

    def kernel(self, windows: np.ndarray) -> np.ndarray:
        """Window by landmark, for an array of windows of WINDOW + SPAN symbols."""
        out = np.zeros((len(windows), self.matrix.shape[1]))
        for i in range(0, len(windows), 256):
            for codes, weight in codes_from(windows[i : i + 256], WINDOW):
                out[i : i + 256] += weight * self.matrix[self.row[codes]].sum(1)
        return out


def text_of(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, places, side="right") - 1


def gram_rows(symbols: np.ndarray, starts: np.ndarray, n: int, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the stream: hash, text and a place of each distinct string of n symbols in each text that `which` marks."""
    for i, j in parts(starts):
        if not which[i:j].any():
            continue
        a, b = starts[i], starts[j]
        hashes = ngram_hash(BYTE_CODE[symbols[a : b + n]], n)[: b - a]
        text = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(starts[i : j + 1]))
        whole = which[text]
        for k in range(n):
            whole &= symbols[a + k : b + k] > 0
        at = np.flatnonzero(whole)
        order = np.lexsort((text[at], hashes[at]))
        at = at[order]
        h, t = hashes[at], text[at]
        once = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])][: len(h)]
        yield h[once], t[once], at[once] + a


def choose_landmarks(symbols: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings that set toxic texts apart, until each such text has COVER of them, with their places in toxic texts.

    For strings of each of the lengths GRAMS, the share of texts that hold it; the best are those in many toxic texts that few of the chosen
    cover yet, and in next to no others. Only strings of toxic texts are held; the other texts are counted part by part.
    """
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    for n in GRAMS:
        held = list(gram_rows(symbols, starts, n, toxic))
        if not held:
            continue
        h, t, at = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(h, kind="stable")
        h, t, at = h[order], t[order], at[order]
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        bad = np.diff(np.r_[cuts, len(h)])
        cuts, bad = cuts[bad >= 3], bad[bad >= 3]
        if not len(cuts):
            continue
        known, good = h[cuts], np.zeros(len(cuts), np.int64)
        for other, _, _ in gram_rows(symbols, starts, n, ~toxic):
            i = np.minimum(np.searchsorted(known, other), len(known) - 1)
            good += np.bincount(i[known[i] == other], minlength=len(known))
        ranked = np.flatnonzero(good / max(1, (~toxic).sum()) <= 0.2 * bad / max(1, toxic.sum()))
        ranked = ranked[np.argsort(-bad[ranked], kind="stable")][:4000]
        need = np.where(toxic, COVER, 0)
        for _ in range(LANDMARKS // len(GRAMS)):
            gains = np.array([np.count_nonzero(need[t[cuts[g] : cuts[g] + bad[g]]] > 0) - 3 * good[g] for g in ranked]) if len(ranked) else np.zeros(0)
            if not len(gains) or gains.max() < 2:
                break
            g = ranked[int(gains.argmax())]
            mine = slice(cuts[g], cuts[g] + bad[g])
            chosen.append((symbols[at[mine][0] : at[mine][0] + n], at[mine]))
            np.subtract.at(need, t[mine], 1)
            ranked = ranked[ranked != g]
    return chosen


def random_places(rng: np.random.Generator, k: int, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """k places of the texts that `which` marks."""
    texts = np.flatnonzero(which)
    size = np.diff(starts)[texts]
    reach = np.cumsum(size)
    u = rng.integers(0, reach[-1], k)
    i = np.searchsorted(reach, u, side="right")
    return starts[texts[i]] + u - (reach[i] - size[i])


def windows_at(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    places = np.clip(places, 0, len(symbols) - WINDOW - SPAN)
    return symbols[places[:, None] + np.arange(WINDOW + SPAN)[None, :]]


def svm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, steps: int = 6000, penalty: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear machine, by averaged stochastic subgradient steps on balanced batches."""
    x = np.c_[x, np.ones(len(x))]
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, steps + 1):
        some = np.concatenate([rng.choice(pos, 8), rng.choice(neg, 24)])
        off = y[some] * (x[some] @ w) < 1
        w = w * (1 - 1 / k) if k > 1 else w
        w = w + (y[some] * off) @ x[some] / (len(some) * penalty * k)
        norm = np.sqrt(w @ w) * np.sqrt(penalty)
        w = w / max(1.0, norm)
        if k > steps // 2:
            mean += w
    return mean / (steps - steps // 2)


def train(rows: list[tuple[bytes, int]], seed: int = 11) -> ToxicityModel:
    """From texts with labels 0 or 1. Where no string sets the toxic texts apart, or a class is missing, scores are constant."""
    rng = np.random.default_rng(seed)
    toxic = np.array([y == 1 for _, y in rows], bool)
    size = 1 << (BITS * ORDER)
    if not toxic.any() or toxic.all():
        return ToxicityModel(np.zeros(size, np.float32), -1.0, np.zeros(TOP), float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1))))
    data = np.frombuffer(b"".join(t for t, _ in rows), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    symbols, starts = stream(data, bounds)
    found = choose_landmarks(symbols, starts, toxic)
    if not found:
        return ToxicityModel(np.zeros(size, np.float32), -1.0, np.zeros(TOP), float(np.log(toxic.mean())))
    random = windows_at(symbols, random_places(rng, 24, starts, ~toxic))
    marks = Landmarks([s for s, _ in found] + [w[:9] for w in random if (w[:9] > 0).all()])
    places = np.unique(np.concatenate([p for _, p in found]))
    if len(places) > 6000:
        places = rng.choice(places, 6000, replace=False)
    positive = windows_at(symbols, np.maximum(0, places - rng.integers(0, 4, len(places))))
    negative = windows_at(symbols, random_places(rng, 6000, starts, ~toxic))
    inner = marks.matrix.T @ marks.matrix
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6
    whiten = vector[:, keep] / np.sqrt(value[keep])
    model = None
    for _ in range(3):
        x = np.concatenate([marks.kernel(positive), marks.kernel(negative)]) @ whiten
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w = svm(x, y, rng)
        table = np.zeros(size, np.float32)
        table[marks.codes] = marks.matrix[:-1] @ (whiten @ w[:-1])
        model = ToxicityModel(table, float(w[-1]), np.zeros(TOP), 0.0)
        wrong = [np.flatnonzero(window_sums(symbols[starts[i] : starts[j] + GAP], model)[: starts[j] - starts[i]] > -0.5) + starts[i] for i, j in parts(starts)]
        hard = np.concatenate(wrong)
        hard = hard[~toxic[text_of(starts, hard)]]
        if not len(hard):
            break
        negative = np.concatenate([negative, windows_at(symbols, rng.choice(hard, min(3000, len(hard)), replace=False))])
    x = np.c_[margins(symbols, starts, model), np.ones(len(toxic))]
    curve = np.zeros(TOP + 1)  # a logistic curve over the texts' margins, by damped Newton steps
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(TOP + 1)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-2 * curve)
        curve = curve - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return ToxicityModel(model.table, model.bias, curve[:-1], float(curve[-1]))


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id", limit: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= limit), a row per row.

    Whole texts count, by their worst windows; null and empty texts have the score of a window without any known sequence.
    Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 19):
                best = margins(*stream(*packed(batch.column("t"))), model)
                score = 1 / (1 + np.exp(-np.clip(best @ model.slopes + model.offset, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.selectExpr(f"cast({key} as long) k", f"{text} t").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    """Train on at most `most` toxic texts and twice as many others. Conflicting labels of one document count as toxic."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    rows = by_class(known.filter(F.col(label) == 1), label, key, most).unionByName(by_class(known.filter(F.col(label) == 0), label, key, 2 * most))
    return train(labelled_texts(docs, rows, key, text, label))
