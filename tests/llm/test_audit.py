"""Filter audit against filters applied one after the other."""

import pytest

from attesta.llm import audit
from attesta.llm import queries as q
from tests.llm import brute

CLEAN = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, CLEAN, "a"), (2, CLEAN, "a"), (2, CLEAN, "b"), (3, CLEAN.upper() + " #", None), (4, "A B", ""), (5, None, "b"), (6, "", None), (7, "x " * 70_000, "b"), (8, CLEAN + " $", "é"),
    (None, CLEAN, "a"), (None, "short", "a"), (9, "short", "c"), (0, "y | y", "c"), (10, "ÀÉ ñ 日本" * 20, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1)]


def as_dict(rows):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in rows}


def test_whole_table(spark, small):
    found = q.op12_filter_audit(spark, small).collect()
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    want = brute.audit(docs, labels)
    assert as_dict(found) == want and len(found) == len(want)
    assert all(any(v[i] for v in want.values()) for i in range(7))


@pytest.mark.parametrize("hot", [1000, 1])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(audit, "HOT_FROM", hot)
    table = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "'x' part", "1 fails", "2 first", "3 step", "4 digest", "true good")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = audit.replay(audit.flags(table.repartition(3), labels)).collect()
    assert as_dict(found) == brute.audit(ROWS, LABELS) and len(found) == 600 * 5
    assert audit.replay(audit.flags(table, labels.limit(0))).filter("good_lost + toxic_lost > 0").isEmpty()
    assert audit.replay(audit.flags(table.limit(0), labels)).collect() == []
