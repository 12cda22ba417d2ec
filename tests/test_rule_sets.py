"""The checks and the three-valued logic of rules as data, and string functions against plain Python."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from attesta.functions import strings
from attesta.operators import rule_sets as R


@pytest.mark.parametrize("tree", [
    {"op": "xor", "of": []}, {"op": "all", "of": []}, {"op": "not", "of": [{"op": "is_true", "field": "a"}] * 2}, {"op": "compare", "field": "a", "by": "like", "value": 1},
    {"op": "compare", "field": "a", "by": "eq", "value": 1, "parameter": "p"}, {"op": "compare", "field": "a", "by": "eq"}, {"op": "in", "field": "a", "values": []}, {"op": "is_true"},
])
def test_bad_trees_are_refused(tree):
    with pytest.raises(ValueError):
        R.check(tree)


def test_three_values_and_missing_fields(spark):
    tree = {"op": "any", "of": [{"op": "compare", "field": "a", "by": "gt", "value": 1}, {"op": "all", "of": [{"op": "is_true", "field": "b"}, {"op": "in", "field": "c", "values": ["x"]}]}]}
    rows = [(2, None, None), (0, True, "x"), (0, False, None), (None, False, "x"), (0, True, None), (None, None, None)]
    table = spark.createDataFrame(rows, "a int, b boolean, c string")
    v = R.compile_rule(tree)
    found = [(r["s"], r["m"]) for r in table.select(R.state(v).alias("s"), R.missing(tree, v).alias("m")).collect()]
    assert found == [("TRUE", []), ("TRUE", []), ("FALSE", []), ("UNKNOWN", ["a"]), ("UNKNOWN", ["c"]), ("UNKNOWN", ["a", "b", "c"])]
    assert R.fields(tree) == ["a", "b", "c"]


def test_fold_agrees_with_unicode(spark):
    text = "Álvarez Ñandú über garçon ÿ 123 - plain"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    assert spark.createDataFrame([(text,)], "t string").select(strings.fold(F.col("t"))).first()[0] == want
    assert len(strings.MARKED) == len(strings.PLAIN)


def test_address_by_hand(spark):
    rows = ["Av. Corrientes 1234, Piso 5", "Calle 9 de Julio 80", "Sin número", "Bv. San Juan 12345 piso 2 B", None]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select(strings.address(F.col("t")).alias("p")).select("p.street", "p.height", "p.floor", strings.street_key(F.col("p.street")).alias("k")).collect()
    assert [tuple(r) for r in found] == [
        ("Av. Corrientes", 1234, 5, "corrientes"), ("Calle 9 de Julio", 80, None, "de julio"), ("Sin número", None, None, "numero sin"), ("Bv. San Juan", 12345, 2, "juan san"), (None, None, None, None),
    ]
