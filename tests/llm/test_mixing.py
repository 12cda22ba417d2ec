"""Mixing: targets and quotas against plain loops, pieces within their documents, odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from attesta.llm import mixing
from attesta.llm import queries as q
from tests.llm import brute

ROWS = [
    (1, "a b c d e f g h i j k l m n o p", "z"), (2, "a b", "z"), (2, "a b", "z"), (2, "a b", "z"), (3, None, "z"), (4, "", None), (None, "one two three four", None),
    (None, None, None), (5, "w " * 30_000, "big"), (6, "  \n\t ", "empty"), (7, "x y z", ""), (8, "ñ é ü 日本  x", "é"),
]


def test_whole_table(spark, small):
    found = q.op11_mixing(spark, small).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    sizes = {}
    for k, d in docs.items():
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(brute.WORD.findall(d["text"] or ""))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in found:
        d = docs[r["doc_id"]]
        assert r["size"] == len(brute.WORD.findall(d["text"] or "")) and r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    assert any(want[s] == 2 * sizes[s] == taken[s] for s in sizes) and any(want[s] < sizes[s] for s in sizes)


@pytest.mark.parametrize("shard", [mixing.SHARD, 64])
def test_odd_rows_and_reruns(spark, shard):
    table = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "'x' size", "'y' h", "1 number", "2 shard", "3 pieces", "4 target")
    run = lambda t: t.withColumn("taken", mixing.taken(F.col("pieces"))).collect()
    found = run(mixing.mix(table.repartition(3), shard=shard))
    assert len(found) == len(ROWS)
    again = run(mixing.mix(table.repartition(5, "text"), shard=shard))
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"], str(r["pieces"]))
    assert sorted(map(key, found)) == sorted(map(key, again))
    sizes, taken = {}, {}
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        end = 0
        for p in r["pieces"]:
            assert p["first"] >= end and p["words"] > 0 and 1 <= p["times"] <= 2
            end = p["first"] + p["words"]
        assert end <= r["size"]
    want = brute.targets(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    assert mixing.mix(table.limit(0)).collect() == []


def test_texts_of_pieces(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string, source string").filter("doc_id in (1, 5, 7, 8)")
    mixed = mixing.mix(table).join(table.select("doc_id", "text"), "doc_id").withColumn("cut", mixing.cut_text(F.col("text"), F.col("pieces")))
    for r in mixed.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert r["cut"] == [" ".join(words[p["first"] : p["first"] + p["words"]]) for p in r["pieces"] for _ in range(p["times"])]


def test_apportionment_is_that_of_highest_quotients(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        votes = {k: rng.choice([1.0, 1.0, 2.0, 3.5, rng.random(), rng.random() * 50]) for k in range(rng.randint(1, 30))}
        seats = rng.choice([0, 1, 2, 7, 40, 400])
        rows += [(g, k, v, seats) for k, v in votes.items()]
        want |= {(g, k): n for k, n in brute.highest_quotients(votes, seats).items()}
    found = mixing.apportion(spark.createDataFrame(rows, "g long, k long, votes double, seats long"), "g", "k").collect()
    assert {(r["g"], r["k"]): r["quota"] for r in found} == want


def test_many_sources_and_a_hot_one(spark):
    table = spark.range(20_000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 60 as int)) text", "if(id % 3 = 0, 'hot', concat('s', id % 700)) source")
    found = mixing.mix(table, shard=2000).withColumn("taken", mixing.taken(F.col("pieces")))
    sums = found.groupBy("source").agg(F.sum("size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    want = brute.targets({r["source"]: r["size"] for r in sums})
    assert {r["source"]: r["target"] for r in sums} == pytest.approx(want)
    assert all(abs(r["taken"] - r["target"]) <= (2 if r["source"] != "hot" else 60) * mixing.BLOCK for r in sums)
    assert found.filter("taken > 2 * size").isEmpty()
