"""A two-stage suffix array over a block of strings, with adjacent common prefixes; vectorised by bucket."""

from __future__ import annotations

import numpy as np

#: Bytes after which suffixes count as equal unless a caller asks for more; a multiple of 4.
DEPTH = 64


class Block:
    """Strings laid end to end, each closed by a 0; bytes are shifted up by one (UTF-8 never uses 255)."""

    def __init__(self, joined: np.ndarray, lengths: np.ndarray):
        n = len(joined) + len(lengths)
        self.ends = np.cumsum(lengths + 1) - 1
        self.text = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        self.text[inside] = joined + np.uint8(1)
        self.left = np.repeat(self.ends, lengths + 1) - np.arange(n)  # bytes up to the string's end
        words = np.zeros(n, np.uint64)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        for k in range(8):
            words |= np.where(self.left > k, padded[k : k + n], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        self.words = words

    def word(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes `depth` after each place, zero beyond the string's end."""
        return self.words[at + np.minimum(depth, self.left[at])]


def rises(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the closing zeros count as such."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if not len(differs):
        return np.ones(n, bool)
    at = np.searchsorted(differs, np.arange(n))
    known = at < len(differs)
    at = differs[np.minimum(at, len(differs) - 1)]
    return (text == 0) | (known & (text[at] < text[np.minimum(at + 1, n - 1)]))


def sort_directly(block: Block, chosen: np.ndarray, most: int = DEPTH) -> np.ndarray:
    """The chosen suffixes in order of their first `most` bytes, by refining groups of equal prefixes."""
    first = block.words[chosen]
    order = np.argsort(first, kind="stable")
    chosen, first = chosen[order], first[order]
    # a group's rank is the slot where it starts
    rank = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], np.arange(len(chosen)), 0))
    active = np.arange(len(chosen))
    depth = 8
    while depth < most:
        group = rank[active]
        tied = np.zeros(len(active), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= block.left[chosen[active]] >= depth
        active = active[tied]
        if not len(active):
            break
        group = rank[active]
        key = ((group - group[0]).astype(np.uint64) << np.uint64(32)) | (block.word(chosen[active], depth) >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        key = key[order]
        chosen[active] = chosen[active][order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        depth += 4
    return chosen


def suffix_array(block: Block, most: int = DEPTH) -> np.ndarray:
    """All suffixes in order of their first `most` bytes: those smaller than their successor are sorted directly; bucket scans induce the others."""
    text = block.text
    n = len(text)
    direct = rises(text)
    counts = np.bincount(text, minlength=256)
    start = np.cumsum(counts) - counts
    induced = np.bincount(text[~direct], minlength=256)
    order = np.empty(n, np.int64)
    sorted_direct = sort_directly(block, np.flatnonzero(direct), most)
    letters = text[sorted_direct]
    base = np.searchsorted(letters, np.arange(257))
    for c in np.flatnonzero(counts - induced):
        order[start[c] + induced[c] : start[c] + counts[c]] = sorted_direct[base[c] : base[c + 1]]
    fill = start.copy()
    for c in np.flatnonzero(counts):
        scanned = start[c]
        while scanned < fill[c]:  # suffixes of a run of one letter: each generation induces the next
            before = order[scanned : fill[c]] - 1
            scanned = fill[c]
            before = before[before >= 0]
            before = before[(text[before] == c) & ~direct[before]]
            order[fill[c] : fill[c] + len(before)] = before
            fill[c] += len(before)
        before = order[start[c] : start[c] + counts[c]] - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & ~direct[before]]
        letters = text[before]
        grouped = np.argsort(letters, kind="stable")
        before, letters = before[grouped], letters[grouped]
        cuts = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1], True]) if len(letters) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = letters[a]
            order[fill[x] : fill[x] + b - a] = before[a:b]
            fill[x] += b - a
    return order


def adjacent_prefixes(block: Block, order: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to `most`, by which the suffixes must be ordered; 0 for the first.

    Where either suffix is shorter than `least`, 0."""
    common = np.zeros(len(order), np.int64)
    long = block.left[order] >= least
    active = np.flatnonzero(long[1:] & long[:-1]) + 1
    for depth in range(0, most, 8):
        a, b = order[active - 1], order[active]
        differ = block.word(a, depth) ^ block.word(b, depth)
        equal = differ == 0
        high = differ[~equal]
        leading = np.zeros(len(high), np.int64)
        for k in range(1, 8):
            leading += high < np.uint64(1) << np.uint64(64 - 8 * k)
        common[active[~equal]] += leading
        active = active[equal]
        common[active] += 8
    limit = block.left[order]
    common[1:] = np.minimum(common[1:], np.minimum(limit[1:], limit[:-1]))
    return np.minimum(common, most)
