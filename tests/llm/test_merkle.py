"""Merkle manifest against the definition, through one and several rounds of blocks."""

import pytest
from pyspark.sql import functions as F

from attesta.llm import merkle
from attesta.llm import queries as q
from attesta.llm.common import crc_mod
from tests.llm import brute

COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (4, "a\nb", "en", "a", 3), (2, "", None, "a", 0), (3, None, "fr", "a", None), (9, "line\n" * 40_000, "en", "a", 5), (None, "x\ny", "en", "a", 3), (5, "é\n日本", "es", None, 4),
    (7, "one\n", "", "é", 4), (8, "\n", "en", "z", 1), (1, "lone", "en", "B", 4), (12, None, None, None, None), (14, "s\n", "en", "", 2),
]


def stripped():
    return F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def by_id(found):
    return {(r["doc_id"], r["leaf"]): tuple(r[c] for c in COLUMNS) for r in found.collect()}


def wanted(rows):
    return {(k, v[0]): v for (k, _), v in brute.merkle(rows).items()}


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = q.op13_merkle(spark, small)
    want = wanted([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()])
    assert found.count() == len(want) and by_id(found) == want
    assert {v[5] for v in want.values()} == {True, False}


@pytest.mark.parametrize(("block", "most"), [(merkle.BLOCK, merkle.TOP), (3, 2), (9, 3), (3, 5)])
def test_odd_rows_and_rounds(spark, block, most):
    more = [(100 + 2 * i, f"t{i}\nu", "en", "many", i) for i in range(95)] + [(1000 + i, f"s\n{i}", "en", f"s{i % 30}", i) for i in range(64)]
    rows = ODD + more
    table = spark.createDataFrame(rows, KINDS).selectExpr("*", "'x' tree", "'y' pos", "1 count", "2 digest", "3 block", "4 place").repartition(4)
    assert by_id(merkle.manifest(table, block, most, stripped())) == wanted(rows)
    assert all(v[5] for v in by_id(merkle.manifest(table, block, most)).values())


def test_repeated_rows_empty_table_and_one_row(spark):
    rows = [(1, "a", "en", "s", 1)] * 4 + [(2, "b\n", "en", "s", 2)]
    found = merkle.manifest(spark.createDataFrame(rows, KINDS)).collect()
    assert len(found) == 5 and all(r["verified"] for r in found) and len({r["root"] for r in found}) == 1
    assert len({r["proof_sha256"] for r in found if r["doc_id"] == 1}) == 2  # three in one run, one in the next
    lone = merkle.manifest(spark.createDataFrame(rows[:1], KINDS)).collect()[0]
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == brute.sha(b"")
    assert merkle.manifest(spark.createDataFrame([], KINDS)).collect() == []
    with pytest.raises(ValueError, match="power"):
        merkle.manifest(spark.createDataFrame(rows, KINDS), block=10)
