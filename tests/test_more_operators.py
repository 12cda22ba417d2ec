"""SQL functions against their DataFrame forms, similarity against its definition, cycles against brute force, paths."""

import datetime as dt
import random

from pyspark.sql import functions as F

from attesta.functions import sql
from attesta.operators import graph, similarity
from attesta.operators import temporal as t


def test_scalar_functions_are_the_same_as_columns(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(k, a, b) for k in ("CLOSED", "UNKNOWN", None) for a in (None, day(1), day(5)) for b in (None, day(3), day(9))]
    table = spark.createDataFrame(rows, "valid_kind string, valid_from date, valid_to date").withColumn("known_from", F.col("valid_from")).withColumn("known_to", F.col("valid_to"))
    table.createOrReplaceTempView("odd")
    sql.register(spark)
    at = F.lit(day(3))
    want = table.select(t.range_resolved().alias("a"), t.range_contains(at).alias("b"), t.known_at(at).alias("c")).collect()
    got = spark.sql("SELECT range_resolved(valid_kind, valid_from, valid_to) a, range_holds(valid_kind, valid_from, valid_to, DATE'2024-01-04') b, known_on(known_from, known_to, DATE'2024-01-04') c FROM odd").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [r[0] for r in spark.sql("SELECT full_year(x) FROM VALUES (0), (40), (41), (99), (1994) v(x)").collect()] == [2000, 2040, 1941, 1999, 1994]


def plain_matched(a, b):
    """The definition, trying all pairs of places."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n and n + plain_matched(a[:i], b[:j]) + plain_matched(a[i + n :], b[j + n :])


def test_similarity_is_that_of_the_definition(spark):
    rng = random.Random(11)
    pairs = [(" ".join(rng.choice("abcdef"[:k]) for _ in range(rng.randint(0, 14))), " ".join(rng.choice("abcdef"[:k]) for _ in range(rng.randint(0, 14)))) for k in (2, 3, 6) for _ in range(60)]
    pairs += [("", ""), (None, "a"), ("a", None), (" a\n b ", "a b"), ("x", "")]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in table.select("i", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = pairs[r.i]
        want = None if a is None or b is None else 1.0 if not (a.split() or b.split()) else 2 * plain_matched(a.split(), b.split()) / (len(a.split()) + len(b.split()))
        assert r.r == want
    assert similarity.similarity("abxcd", "abcd", characters=True) == 8 / 9
    long = " ".join(f"w{i}" for i in range(60_000))
    assert similarity.similarity(long, long) == 1.0


def test_many_texts_are_compared_in_one_step(monkeypatch):
    rng = random.Random(12)
    text = lambda k, n: " ".join(rng.choice("abcdefghij"[:k]) for _ in range(rng.randint(0, n)))
    pairs = [(text(k, 30), text(k, 30)) for k in (1, 2, 5, 10) for _ in range(60)] + [(None, "a"), ("", ""), ("a", "")]
    want = [None if a is None else 2 * plain_matched(a.split(), b.split()) / len((a + " " + b).split()) if (a + b).split() else 1.0 for a, b in pairs]
    for words, meetings in ((40, 60), (12, 5), (1 << 18, 100)):  # some pairs are too large for a step and taken apart first
        monkeypatch.setattr(similarity, "WORDS", words)
        monkeypatch.setattr(similarity, "MEETINGS", meetings)
        assert similarity.similarities(*zip(*pairs, strict=True)) == want
    monkeypatch.undo()
    monkeypatch.setattr(similarity, "longest_run", None)  # texts of common size need no search row by row
    assert similarity.similarities(*zip(*pairs, strict=True)) == want


def brute_cyclic(edges):
    """What is left when nodes without a way on or a way in are taken off."""
    left = set(edges)
    while True:
        on, into = {a for a, _ in left}, {b for _, b in left}
        now = {(a, b) for a, b in left if b in on and a in into}
        if now == left:
            return {n for e in left for n in e}
        left = now


def test_nodes_on_cycles(spark):
    rng = random.Random(2)
    for n, m in ((30, 25), (200, 240)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(5, 5), (5, 5), (None, 3)]
        found = graph.cyclic(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node for r in found.collect()} == brute_cyclic([e for e in edges if e[0] is not None])
    assert graph.cyclic(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).collect() == []
    assert graph.cyclic(spark.createDataFrame([], "a long, b long")).collect() == []


def test_paths_of_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6)], "a long, b long")
    found = graph.reach(edges, spark.createDataFrame([(1,), (1,), (9,)], "root long"), 3, paths=True)
    assert {(r.node, r.depth): r.path for r in found.collect()} == {(2, 1): [1, 2], (3, 1): [1, 3], (4, 2): [1, 2, 4], (5, 3): [1, 2, 4, 5]}
