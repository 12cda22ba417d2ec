"""Plain single-process versions of the operators, to hold small results against."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(docs: dict[int, str | None], span: int = 50) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256), and the kept pieces of text."""
    first: dict[bytes, int] = {}
    texts = {k: (t or "").encode() for k, t in docs.items()}
    for k in sorted(texts):
        t = texts[k]
        for i in range(len(t) - span + 1):
            first.setdefault(t[i : i + span], k)
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < k:
                gone[i : i + span] = b"\x01" * span
        runs = re.findall(rb"\x01+", bytes(gone))
        kept = [t[m.start() : m.end()] for m in re.finditer(rb"\x00+", bytes(gone))]
        out[k] = (len(t), sum(map(len, runs)), len(runs), sha(b"".join(kept)), "".join(x.decode("utf-8", "ignore") for x in kept))
    return out


def shingles(text: str | None, width: int) -> set:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near(docs: dict[int, str | None], width: int, percent: int) -> dict[int, tuple]:
    """doc_id: (n_shingles, component_id)."""
    sets = {k: shingles(t, width) for k, t in docs.items()}
    top = {k: k for k in docs}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    held = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            held[x].append(k)
    for k in sorted(sets):
        shared = defaultdict(int)
        for x in sets[k]:
            for j in held[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[j]) + len(sets[k]) - n):
                a, b = find(j), find(k)
                top[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in docs}


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def base_failed(m: tuple) -> bool:
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def best_fit(pieces: list[tuple], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece (size, source, cluster) in turn: the tightest that may hold it, the oldest of equals that became so first."""
    bins: list[dict] = []
    out = []
    clock = 0
    for size, source, cluster in pieces:
        fits = [b for b in bins if b["room"] >= size and b["room"] > 0 and b["sources"].count(source) < per_source and cluster not in b["clusters"]]
        if fits:
            b = min(fits, key=lambda x: (x["room"], x["since"]))
        else:
            b = {"n": len(bins), "room": capacity, "sources": [], "clusters": set()}
            bins.append(b)
        b["room"] -= size
        b["sources"].append(source)
        b["clusters"].add(cluster)
        clock += 1
        b["since"] = clock
        out.append(b["n"])
    return out


def host_rates(hosts: dict) -> dict:
    """host: (shrunk failure rate, its lower bound), from host: (documents, failures)."""
    weight = {h: min(n, 100) for h, (n, _) in hosts.items()}
    whole = sum(weight.values())
    mean = sum(weight[h] * f / n for h, (n, f) in hosts.items()) / whole
    spread = sum(weight[h] * (f / n - mean) ** 2 for h, (n, f) in hosts.items()) / whole
    noise = sum(weight[h] * mean * (1 - mean) / n for h, (n, _) in hosts.items()) / whole
    strength = min(max(mean * (1 - mean) / max(spread - noise, 1e-9) - 1, 1.0), 1000.0)
    out = {}
    for h, (n, f) in hosts.items():
        rate = (f + mean * strength) / (n + strength)
        out[h] = (rate, rate - 2.33 * (rate * (1 - rate) / (n + strength + 1)) ** 0.5)
    return out


BANDS = [(1, 6), (6, 12), (12, 24), (24, 48), (48, 97)]


def peaks_fit(payload: bytes, found) -> bool:
    """Whether found holds, for each frame and band, a bin of the largest power by the transform's definition, or 0 for silence."""
    n = np.arange(192)
    turn = np.exp(-2j * np.pi * np.outer(n[:97], n) / 192)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 191)
    for f, got in zip(range(0, len(payload) // 192), found, strict=True):
        x = np.array(list(payload[192 * f : 192 * f + 192]), float) - 128
        power = abs(turn @ ((x - x.mean()) * window))
        for (lo, hi), b in zip(BANDS, got, strict=True):
            top = power[lo:hi].max()
            if b == 0 and top > 2e-3 or b and not (lo <= b < hi and power[b] >= top * 0.999 - 1e-3):
                return False
    return True


def peak_pairs(found: list[list[int]]) -> list[tuple[int, int]]:
    """(frame, code) of each peak with the next band's peak, one to three frames later; the last band's partner is the first."""
    out = []
    for i, row in enumerate(found):
        for gap in (1, 2, 3):
            if i + gap < len(found):
                for k, a in enumerate(row):
                    b = found[i + gap][(k + 1) % len(row)]
                    if a and b:
                        out.append((i, a << 10 | b << 2 | gap))
    return sorted(out)


def worst_windows(text: str, table, bias: float, decay: float = 0.6) -> list[float]:
    """The three largest window sums of a text's stretches of 32 symbols, by the kernel's definition: all sequences of four symbols
    within seven places, from each of a window's twelve places."""
    from itertools import combinations

    symbols = []
    for b in text.encode():
        c = chr(b).lower()
        s = ord(c) - 96 if "a" <= c <= "z" else 27 if c in "\t\n\x0b\x0c\r " else 28 + (b - 128) % 4 if b > 127 else 0
        if s:
            symbols.append(s)
    letter = [s != 27 for s in symbols]
    at = lambda i: 0 <= i < len(symbols) and letter[i]
    symbols = [s for i, s in enumerate(symbols) if not (s == 27 and at(i - 1) and not at(i - 2) and at(i + 1) and not at(i + 2))]
    place = []
    for i in range(len(symbols)):
        total = 0.0
        for rest in combinations(range(1, 7), 3):
            if i + rest[-1] < len(symbols):
                code = 0
                for s in (symbols[i], *(symbols[i + r] for r in rest)):
                    code = code << 5 | s
                total += float(table[code]) * decay ** (rest[-1] - 3)
        place.append(total)
    sums = [min(3, max(-2, sum(place[i : i + 12]) + bias)) for i in range(len(place))]
    best = sorted((max(sums[i : i + 32]) for i in range(0, len(sums), 32)), reverse=True)[:3]
    return best + [-2.0] * (3 - len(best))


def targets(sizes):
    """Targets by source from {source: size}: weights in code-point order, null last; full sources are held and the rest shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return {s: 2.0 * sizes[s] for s in order}
        level = (want - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if weight[s] * level >= 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def highest_quotients(votes, seats):
    """Seats one by one to the highest votes / (2 * seats held + 1); ties to the smaller key."""
    held = dict.fromkeys(votes, 0)
    for _ in range(seats):
        held[min(votes, key=lambda k: (-votes[k] / (held[k] + 0.5), k))] += 1
    return held


def audit(docs, labels):
    """Filters applied one after the other, for each of 120 orders. docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    ids = {}
    for k, text, _ in docs:
        ids.setdefault(text or "", []).append(k)

    def fails(k, text):
        text = text or ""
        words = WORD.findall(text)
        return {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": k is not None and any(i is not None and i < k for i in ids[text]),
        }

    parts = {}
    for k, text, source in docs:
        parts.setdefault(source or "", []).append((k, fails(k, text)))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in rows) - len(gone)
                left = [r for r in left if not r[1][f]]
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                total[f] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def merkle(docs):
    """doc: (leaf, subroot, root, proof, folded, verified) by definition. docs: (doc_id, text, lang, source, n_chars), ids unique or null once a source."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(k, text, lang, source, n):
        return sha("".join(map(field, (k, source, lang, n, text))).encode())

    def tree(nodes):
        """The root, and for each leaf its list of (left siblings, right siblings)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for i, path in enumerate(steps):
                run, j = runs[at[i] // 3], at[i] % 3
                path.append((run[:j], run[j + 1 :]))
                at[i] //= 3
            nodes = [sha("".join(r).encode()) for r in runs]
        return nodes[0], steps

    sources = {}
    for d in docs:
        sources.setdefault(d[3], []).append(d)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        trees[s] = sorted(sources[s], key=lambda d: (d[0] is not None, d[0] or 0))
    built = {s: tree([leaf(*d) for d in rows]) for s, rows in trees.items()}
    root, upper = tree([built[s][0] for s in order])
    out = {}
    for s, above in zip(order, upper, strict=True):
        subroot, steps = built[s]
        for d, path in zip(trees[s], steps, strict=True):
            k, text, lang, source, n = d
            path = path + above
            changed = text.replace("\n", "") if text is not None and k is not None and zlib.crc32(str(k).encode()) % 2 == 0 else text
            folded = leaf(k, changed, lang, source, n)
            for before, after in path:
                folded = sha("".join([*before, folded, *after]).encode())
            out[k, s] = (leaf(*d), subroot, root, sha("".join(x for b, a in path for x in (*b, *a)).encode()), folded, folded == root)
    return out
