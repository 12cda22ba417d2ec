"""Faults of stored rules, their comparisons, values by day, and verdicts of benefits against a plain reading of the rules."""

import datetime as dt
import itertools
from decimal import Decimal

import pytest

from attesta.operators import rule_contract as R


def leaf(**more):
    return {"schema_version": "1.0", "op": "compare", "field": "a", "cmp": ">=", "value": 1, "unit": "ARS"} | more


@pytest.mark.parametrize(("tree", "path"), [
    ([], "$"), ({"op": "is_true", "field": "a"}, "$"), (leaf(schema_version="2.0"), "$"), (leaf(op="xor"), "$"), (leaf(unit=None), "$"), (leaf(unit="EUR"), "$"), (leaf(cmp="ge"), "$"),
    (leaf(parameter="P"), "$"), (leaf(field="A"), "$"), (leaf(field="a-b"), "$"), ({k: v for k, v in leaf(parameter="p").items() if k != "value"}, "$"),
    ({k: v for k, v in leaf(parameter="P", factor="1,5").items() if k != "value"}, "$"), ({"schema_version": "1.0", "op": "all", "args": []}, "$"), ({"schema_version": "1.0", "op": "all", "args": {}}, "$"),
    ({"schema_version": "1.0", "op": "not", "args": [leaf(), leaf()]}, "$"), ({"schema_version": "1.0", "op": "any", "args": [leaf(), {"op": "not", "args": [leaf(op="in", values=[1, "1"])]}]}, "$.args[1].args[0]"),
    ({"schema_version": "1.0", "op": "any", "args": [leaf(), 3]}, "$.args[1]"), (leaf(op="in", values=[]), "$"),
])
def test_faults(tree, path):
    with pytest.raises(R.Fault) as e:
        R.check(tree)
    assert e.value.path == path


def test_names_of_fields_and_parameters():
    tree = {"schema_version": "1.0", "op": "all", "args": [leaf(field="b.c"), {"op": "not", "args": [{"op": "in", "field": "a", "values": ["x"]}]}, {k: v for k, v in leaf(field="b.c", parameter="P.1", factor="1.50").items() if k != "value"}]}
    R.check(tree)
    assert R.fields(tree) == ["b.c", "a"] and R.parameters(tree) == ["P.1"]


def test_comparisons_by_kind(spark):
    rows = [(Decimal("0.30"), 0.1 + 0.2, "10", dt.date(2024, 2, 29), True, 3), (None, None, "x", None, None, None), (Decimal("0.31"), 0.3, "", dt.date(2023, 1, 1), False, 0)]
    facts = spark.createDataFrame(rows, "d decimal(10,2), f double, t string, day date, b boolean, n int")
    cases = {
        ("d", "==", 0.3): [True, None, False], ("d", ">", "0.3"): [False, None, True], ("d", ">", "much"): [None] * 3, ("f", "==", 0.3): [False, None, True], ("t", ">", 9): [True, None, None],
        ("t", "<", "9"): [True, False, True], ("day", "<=", "2023-12-31"): [False, None, True], ("day", "<=", "2023-02-30"): [None] * 3, ("b", "==", True): [True, None, False], ("n", "==", True): [True, None, False],
        ("b", "!=", "x"): [False, None, True], ("n", "==", None): [None] * 3,
    }
    got = facts.select(*(R.compiled(leaf(field=f, cmp=c, value=v), facts.schema).alias(str(i)) for i, (f, c, v) in enumerate(cases))).collect()
    assert {k: [r[i] for r in got] for i, k in enumerate(cases)} == cases
    others = [{"op": "in", "field": "n", "values": ["3", 4]}, {"op": "is_true", "field": "t"}, {"op": "is_true", "field": "n"}, {"op": "not", "args": [{"op": "is_true", "field": "b"}]}]
    got = facts.select(*(R.compiled(t, facts.schema).alias(str(i)) for i, t in enumerate(others))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False), (None, True, None, None), (False, False, False, True)]


def test_values_by_day(spark):
    day = lambda n: dt.date(2024, 1, n)
    held = [("P", "10.5", day(1), day(9), "APPROVED"), ("P", "11", day(5), None, "PUBLISHED"), ("P", "99", day(6), None, "CANDIDATE"), ("Q", "x", None, None, "APPROVED"), ("Z", "1", None, None, "APPROVED")]
    catalogue = spark.createDataFrame(held, "code string, value string, valid_from date, valid_to date, review string")
    facts = spark.createDataFrame([(1, day(1)), (2, day(7)), (3, dt.date(2023, 1, 1)), (4, None), (5, day(7))], "a int, on date")
    got = {r.a: (r["parameter P"], r["parameter Q"]) for r in R.with_parameters(facts, catalogue, ["P", "Q"], "on").collect()}
    assert got == {1: (Decimal("10.5"), None), 2: (Decimal("11"), None), 3: (None, None), 4: (None, None), 5: (Decimal("11"), None)}
    tree = {k: v for k, v in leaf(parameter="P", factor="0.1").items() if k != "value"}
    found = R.with_parameters(facts, catalogue, ["P"], "on")
    assert {r.a: r.v for r in found.select("a", R.compiled(tree, found.schema).alias("v")).collect()} == {1: False, 2: True, 3: None, 4: None, 5: True}


def by_hand(values, kinds, lifts):
    """The verdict of rules whose values are known, by the order of what counts."""
    if None in values.values():
        return "NEEDS_DATA"
    for r, kind in kinds.items():
        if (kind == "ACCESS" and not values[r]) or (kind == "EXCLUSION" and values[r]):
            if not any(values[e] for e, of in lifts.items() if r in of):
                return "NOT_MET"
    return "MAY_APPLY"


def test_verdicts_of_all_combinations(spark):
    kinds, lifts = {"a": "ACCESS", "x": "EXCLUSION", "e": "EXCEPTION", "s": "SAFEGUARD"}, {"e": ["a"]}
    rules = [{"id": k, "category": c, "exception_of": lifts.get(k, []), "tree": {"schema_version": "1.0", "op": "is_true", "field": k}} for k, c in kinds.items()]
    rows = list(itertools.product([True, False, None], repeat=4))
    facts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a boolean, x boolean, e boolean, s boolean")
    got = {r.i: r for r in R.verdicts(facts, rules, ["i"]).collect()}
    for i, row in enumerate(rows):
        values = dict(zip("axe", row, strict=False))
        assert got[i].verdict == by_hand(values, kinds, lifts)
        assert got[i].questions == [k for k in "axe" if values[k] is None]
        state = {True: "TRUE", False: "FALSE", None: "UNKNOWN"}[values["e"]]
        assert [tuple(w) for w in got[i].remedies] == [("a", "e", state)] * (values["a"] is False) + [("x", None, None)] * (values["x"] is True)
    for hidden in ({"tree": None}, {"review": True}):
        reviewed = R.verdicts(facts, [*rules, rules[0] | {"id": "z", "category": "EXCEPTION"} | hidden], ["i"])
        assert {r.verdict for r in reviewed.collect()} == {"NEEDS_REVIEW"}
        later = R.verdicts(facts, [*rules, rules[0] | {"id": "z", "category": "REVOCATION"} | hidden], ["i"])
        assert {r.i: r.verdict for r in later.collect()} == {i: r.verdict for i, r in got.items()}
    empty = R.verdicts(facts, [], ["i"])
    assert {(r.verdict, *r.questions, *r.remedies) for r in empty.collect()} == {("MAY_APPLY",)} and R.verdicts(facts.limit(0), rules, ["i"]).count() == 0
