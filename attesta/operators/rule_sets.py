"""Rules as data: JSON trees are checked and compiled to columns under three-valued logic, so that Catalyst sees one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of a tree and of a comparison.
OPERATORS = ("all", "any", "not", "compare", "in", "is_true")
COMPARATORS = {
    "eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__,
}


def check(tree: dict) -> None:
    """Raise ValueError unless the tree is one of the closed set of operators, with what each needs and no more."""
    op = tree.get("op")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if op in ("all", "any", "not"):
        of = tree.get("of") or []
        if not of or (op == "not" and len(of) != 1):
            raise ValueError(f"{op} needs {'one tree' if op == 'not' else 'trees'}")
        for t in of:
            check(t)
    elif "field" not in tree:
        raise ValueError(f"{op} needs a field")
    elif op == "compare":
        if tree.get("by") not in COMPARATORS:
            raise ValueError(f"unknown comparator {tree.get('by')!r}")
        if ("value" in tree) == ("parameter" in tree):
            raise ValueError("a comparison has a value or a parameter, not both")
    elif op == "in" and not tree.get("values"):
        raise ValueError("in needs values")


def fields(tree: dict) -> list[str]:
    """The fields of a tree in order of appearance, once each."""
    found = [tree["field"]] if "field" in tree else [f for t in tree["of"] for f in fields(t)]
    return list(dict.fromkeys(found))


def compile_rule(tree: dict, parameters: dict | None = None) -> Column:
    """true, false or null (unknown) for each row. Unknown fields make a tree unknown unless the others decide it."""
    check(tree)
    op = tree["op"]
    if op in ("all", "any"):
        parts = [compile_rule(t, parameters) for t in tree["of"]]
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~compile_rule(tree["of"][0], parameters)
    field = F.col(tree["field"])
    if op == "compare":
        value = tree["value"] if "value" in tree else (parameters or {})[tree["parameter"]]
        return COMPARATORS[tree["by"]](field, F.lit(value))
    if op == "in":
        return field.isin(*tree["values"])
    return field.cast("boolean")


def state(verdict: Column) -> Column:
    return F.when(verdict, "TRUE").when(~verdict, "FALSE").otherwise("UNKNOWN")


def missing(tree: dict, verdict: Column) -> Column:
    """The fields of a tree that are null, in its order, where its verdict is unknown."""
    names = F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields(tree)))
    return F.when(verdict.isNull(), F.filter(names, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
