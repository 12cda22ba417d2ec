"""Relational queries on small fixtures that the driver's smallest tables are too small for."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import relational as r
from attesta.plans import relational
from attesta.sources.shared import numbered


def test_jurisdiction_marks_every_supplier(spark, tmp_path):
    rows = [(i, f"S{i * 37 % 1000:04}", 7 if i < 150 else i % 25) for i in range(400)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((x.place, x.other, x.s_name, x.s_suppkey) for x in relational.jurisdiction_marked(spark, str(tmp_path)).collect())
    want = sorted((n != 7, name, i) for i, name, n in rows)
    assert got == [(place, *w) for place, w in enumerate(want, 1)]


def test_places_of_equal_names_nulls_few_and_no_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "same") for i in range(300)], "id long, name string")
    order = (F.col("name"), F.col("id"))
    want = sorted(range(300), key=lambda i: (i % 7 != 0, i))
    assert [x.id for x in sorted(numbered(rows, *order).collect(), key=lambda x: x.place)] == want
    assert [x.place for x in numbered(rows.filter("id = 3"), *order).collect()] == [1]
    assert numbered(rows.filter("id < 0"), *order).count() == 0


@pytest.mark.parametrize("parts", [1024, 3])
def test_ranks_within_keys_of_ties_nulls_and_a_hot_key(spark, monkeypatch, parts):
    monkeypatch.setattr(r, "PARTS", parts)
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([rng.random() * 1e9, 5, 5, -3]))) for _ in range(900)] + [("one", 2.5)] * 40 + [("rare", 1.0), ("rare", 2.0), (None, 7.0), (None, None), ("none", None)]
    rows += [("wide", v) for v in (-1e300, -1.0, 0.0, 1e-300, 1.0, 1e300)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"a": "0.95", "b": "0.5", "c": "0.0001", "d": "1"}
    got = {x.k: tuple(x[c] for c in shares) for x in r.at_ranks(df, "k", "v", {c: r.discrete_rank(p) for c, p in shares.items()}).collect()}
    want = {}
    for k in ("hot", "one", "rare", None, "wide"):
        held = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = tuple(held[max(0, math.ceil(float(p) * len(held) - 1e-9) - 1)] for p in shares.values())
    assert got == want
    assert r.at_ranks(df.filter("k = 'none'"), "k", "v", {"a": r.nearest_rank("0.9")}).count() == 0


def test_conciliation_shows_rows_that_nothing_accounts_for(spark):
    rows = [("a", "x", 30), ("a", "x", 30), ("a", "y", 30), ("a", "z", 5), ("b", "x", 30), ("b", "w", None), (None, "v", 30)]
    df = spark.createDataFrame(rows, "source string, text string, n_chars long")
    got = r.conciliation(df, "source", F.col("text"), F.col("n_chars") >= 20, F.col("n_chars") < 20)
    found = {x.source: (x.read, x.fresh, x.repeated, x.rejected, x.balanced) for x in got.collect()}
    assert found == {"a": (4, 2, 1, 1, True), "b": (2, 1, 0, 0, False), None: (1, 1, 0, 0, True)}
