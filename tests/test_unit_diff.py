"""Unit diffs against the same rules step by step: what stayed, then what moved by its turn, then what was rewritten, added or removed."""

import random
from collections import defaultdict

import duckdb

from attesta.operators import rules
from attesta.plans import domain, registry  # noqa: F401

UNITS = "doc long, place int, unit string"


def plain(old, new):
    out = [(p, "SAME") for p in old if p in new and old[p] == new[p]]
    a, b = ({p: u for p, u in x.items() if y.get(p, object()) != u} for x, y in ((old, new), (new, old)))
    homes = defaultdict(list)
    for p in sorted(b):
        homes[b[p]].append(p)
    for p in sorted(a):
        if homes[a[p]]:
            to = homes[a[p]].pop(0)
            out.append((to, "MOVED"))
            del a[p], b[to]
    return out + [(p, "MODIFIED" if p in a and p in b else "REMOVED" if p in a else "ADDED") for p in a.keys() | b.keys()]


def test_unit_that_stayed_is_settled_before_equal_ones_move(spark):
    old = spark.createDataFrame([(1, 0, "X"), (1, 1, "A")], UNITS)
    new = spark.createDataFrame([(1, 0, "A"), (1, 1, "A")], UNITS)
    got = sorted((x.place, x.change) for x in rules.unit_diff(old, new, ["doc"]).collect())
    assert got == [(0, "MODIFIED"), (1, "SAME")]


def test_random_versions_match_the_plain_rules(spark):
    dice = random.Random(5)
    sides = [{d: {p: dice.choice("ABCD") for p in range(dice.randrange(9))} for d in range(60)} for _ in "ab"]
    old, new = (spark.createDataFrame([(d, p, u) for d, us in s.items() for p, u in us.items()], UNITS) for s in sides)
    got = sorted((x.doc, x.place, x.change) for x in rules.unit_diff(old, new, ["doc"]).collect())
    assert got == sorted((d, *c) for d in range(60) for c in plain(sides[0][d], sides[1][d]))
    assert rules.unit_diff(old.filter("doc < 0"), new.filter("doc < 0"), ["doc"]).count() == 0


def test_sides_that_come_from_shuffled_joins_are_paired(spark, small):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        got = sorted(tuple(x) for x in registry.QUERIES["unit_diff"](spark, small).select("doc_id", "change", "n").collect())
    finally:
        spark.conf.set(name, before)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == sorted(db.execute(f"SELECT doc_id, change, n FROM ({registry.ORACLE['unit_diff']})").fetchall())
