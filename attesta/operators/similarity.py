"""How alike two texts are, by the words of their matching runs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of texts, and pairs of equal words, that are compared in one step; a pair of texts with more is taken apart run by run first.
WORDS, MEETINGS = 1 << 18, 1 << 20
#: Bits of a place in a step's texts.
PLACE = 20


def coded(words: list[str], number: dict[str, int]) -> np.ndarray:
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest run that both hold; of several the first in a, then the first in b.

    Runs that end at a word of a come from those that end at the word before it, one row at a time, so memory is that of one row."""
    reach = np.zeros(len(b) + 1, np.int32)
    best, end_a, end_b = 0, 0, 0
    for i, word in enumerate(a.tolist()):
        after = np.zeros(len(b) + 1, np.int32)
        hit = np.flatnonzero(b == word) + 1
        after[hit] = reach[hit - 1] + 1
        reach = after
        if len(hit):
            top = int(reach[hit].max())
            if top > best:
                best, end_a, end_b = top, i + 1, int(hit[np.argmax(reach[hit])])
    return end_a - best, end_b - best, best


def meetings(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of a word of a and an equal one of b there are."""
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = [np.bincount(c, minlength=code.max() + 1) for c in (code[: len(a)], code[len(a) :])]
    return int(counts[0] @ counts[1])


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words in matching runs: the longest run, and again what matches on both sides of it. What is small enough is left to matched_all."""
    total, open_, small = 0, [(0, len(a), 0, len(b))], []
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        met = meetings(a[a0:a1], b[b0:b1])
        if met <= MEETINGS and a1 - a0 + b1 - b0 <= WORDS:
            small += [(a[a0:a1], b[b0:b1])] if met else []
            continue
        i, j, n = longest_run(a[a0:a1], b[b0:b1])
        total += n
        open_ += [(a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)] if n else []
    return total + sum(int(matched_all([x]).sum()) for x in small)


def runs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Pair, start in a, start in b and length of all runs that can't be made longer, by pair; places count on over all pairs, with a gap
    between two."""
    lengths_a, lengths_b = (np.array([len(x[k]) for x in pairs]) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
    many = int(max(a.max(initial=0), b.max(initial=0))) + 1
    of_a, of_b = np.repeat(np.arange(len(pairs)), lengths_a), np.repeat(np.arange(len(pairs)), lengths_b)
    order = np.argsort(of_b * many + b, kind="stable")
    held, asked = (of_b * many + b)[order], of_a * many + a
    low, high = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
    n = high - low
    at = np.repeat(np.arange(len(a)), n)
    to = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(at))]
    pair, i, j = of_a[at], at + of_a[at], to + of_b[to]
    order = np.lexsort((i, j - i))
    pair, i, j = pair[order], i[order], j[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), (np.diff(i) != 1) | (np.diff(j) != 1)]))
    length = np.diff(np.append(first, len(i)))
    by = np.argsort(pair[first], kind="stable")
    return tuple(x[by] for x in (pair[first], i[first], j[first], length))


def matched_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """matched() of each pair; WORDS words and MEETINGS pairs of equal ones at most in all.

    All longest runs of a text pair are cut out of runs that can't be made longer. Each round takes the longest run of each open part of
    each pair, the first in a, then in b, and cuts all other runs down to the parts before and after it."""
    total = np.zeros(len(pairs), np.int64)
    if not pairs:
        return total
    part, i, j, n = runs(pairs)
    last = (1 << PLACE) - 1
    of = np.arange(len(pairs))  # the pair of each part
    while len(n):
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        best = np.maximum.reduceat((n << (2 * PLACE)) | ((last - i) << PLACE) | (last - j), start)
        top, top_i, top_j = best >> (2 * PLACE), last - (best >> PLACE & last), last - (best & last)
        of = of[part[start]]
        np.add.at(total, of, top)
        k = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
        before = np.minimum(n, np.minimum(top_i[k] - i, top_j[k] - j))
        skip = np.maximum(0, np.maximum((top_i + top)[k] - i, (top_j + top)[k] - j))
        x, y = np.flatnonzero(before > 0), np.flatnonzero(n > skip)
        part = np.concatenate([2 * k[x], 2 * k[y] + 1])
        order = np.argsort(part, kind="stable")
        part, i, j, n = part[order], np.concatenate([i[x], (i + skip)[y]])[order], np.concatenate([j[x], (j + skip)[y]])[order], np.concatenate([before[x], (n - skip)[y]])[order]
        of = np.repeat(of, 2)
    return total


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both without a whole equal text: equal texts match in full and need no search."""
    if len(a) == len(b) and (a == b).all():
        return a[:0], b[:0], len(a)
    return a, b, 0


def similarities(ones: Iterable[str | None], others: Iterable[str | None], characters: bool = False) -> list[float | None]:
    """2 * matched words / words of both (or characters, of short texts); 1 for two texts without any, null if one is null."""
    found: list[float | None] = []
    held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # of pairs to compare: number, words of both, words matched already, and what is left
    number: dict[str, int] = {}
    size = met = 0

    def settle() -> None:
        for (at, whole, n, _, _), more in zip(held, matched_all([x[3:] for x in held]).tolist(), strict=True):
            found[at] = 2 * (n + more) / whole
        held.clear()
        number.clear()

    for one, other in zip(ones, others, strict=True):
        found.append(None)
        if one is None or other is None:
            continue
        a, b = (coded(list(x) if characters else x.split(), number) for x in (one, other))
        whole = len(a) + len(b)
        a, b, n = trimmed(a, b)
        if not len(a) or not len(b):
            found[-1] = 2 * n / whole if whole else 1.0
            continue
        more = meetings(a, b)
        if more > MEETINGS or whole > WORDS:
            found[-1] = 2 * (n + matched(a, b)) / whole
            continue
        if size + whole > WORDS or met + more > MEETINGS:
            settle()
            size = met = 0
            # codes of the pair at hand stay as they are: they are compared with each other only
        held.append((len(found) - 1, whole, n, a, b))
        size, met = size + whole, met + more
    settle()
    return found


def similarity(one: str | None, other: str | None, characters: bool = False) -> float | None:
    """similarities() of one pair."""
    return similarities([one], [other], characters)[0]


def ratio(one: Column, other: Column, characters: bool = False) -> Column:
    """similarity() of two columns of texts, whole, in Arrow batches. Two long texts that share many words take time in proportion to the product of their lengths."""

    def run(ones: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series(similarities(ones, others, characters), dtype="float64")

    return F.pandas_udf(run, "double")(one, other)
