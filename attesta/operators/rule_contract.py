"""Stored rules in full: what a tree may hold, its comparison by decimals, days or text, and the verdict of a benefit's rules of all categories."""

from __future__ import annotations

import decimal
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StructType

from attesta.operators.rule_sets import state

# fixed values: the stored form of a rule
SCHEMA = "1.0"
TREES = ("all", "any", "not")
LEAVES = ("compare", "in", "is_true")
COMPARATORS = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
UNITS = ("anios_cumplidos", "meses", "dias", "ARS", "USD", "cantidad", "porcentaje", "booleano", "texto", "fecha")
PARAMETER, FIELD = re.compile("[A-Z0-9][A-Z0-9_.-]*"), re.compile("[a-z][a-z0-9_.]*")
#: Categories that decide; rules of others are told or apply later, and never exclude.
DECIDING = ("ACCESS", "EXCLUSION", "EXCEPTION")
#: Decimals of a value, a factor, and both sides of a comparison; further decimals are rounded, and what has over 20 digits before them is unknown.
VALUE, FACTOR, SIDE = "decimal(24,6)", "decimal(12,6)", "decimal(38,18)"


class Fault(ValueError):
    """What a tree has that the contract doesn't, and where."""

    def __init__(self, told: str, path: str):
        super().__init__(f"{path}: {told}")
        self.path = path


def is_decimal(value: object) -> bool:
    try:
        return decimal.Decimal(str(value)).is_finite()
    except decimal.InvalidOperation:
        return False


def check(tree: object, path: str = "$") -> None:
    """Raise the first Fault of a tree: it is an object of the version, each node one of the closed set of operators with what that needs."""
    if not isinstance(tree, dict):
        raise Fault("a node is an object", path)
    if path == "$" and tree.get("schema_version") != SCHEMA:
        raise Fault(f"schema_version is {SCHEMA}, not {tree.get('schema_version')!r}", path)
    op = tree.get("op")
    if op in TREES:
        args = tree.get("args")
        if not isinstance(args, list) or not args or (op == "not" and len(args) > 1):
            raise Fault(f"{op} takes a list of {'one' if op == 'not' else 'one or more'} in args", path)
        for i, t in enumerate(args):
            check(t, f"{path}.args[{i}]")
        return
    if op not in LEAVES:
        raise Fault(f"no operator {op!r}", path)
    if not isinstance(tree.get("field"), str) or not FIELD.fullmatch(tree["field"]):
        raise Fault(f"no name of a field: {tree.get('field')!r}", path)
    if op == "in":
        values = tree.get("values")
        if not isinstance(values, list) or not values or len({str(v) for v in values}) < len(values):
            raise Fault("in takes a list of different values", path)
    if op == "compare":
        faults = {
            f"no comparator {tree.get('cmp')!r}": tree.get("cmp") not in COMPARATORS,
            "a comparison has either a value or a parameter": ("value" in tree) == ("parameter" in tree),
            f"no code of a parameter: {tree.get('parameter')!r}": "parameter" in tree and not (isinstance(tree["parameter"], str) and PARAMETER.fullmatch(tree["parameter"])),
            f"no decimal factor: {tree.get('factor')!r}": tree.get("factor") is not None and not is_decimal(tree["factor"]),
            f"no unit {tree.get('unit')!r}": tree.get("unit") not in UNITS,
        }
        for told, found in faults.items():
            if found:
                raise Fault(told, path)


def walk(tree: dict):
    """The leaves of a tree in order."""
    for t in tree.get("args", []):
        yield from walk(t)
    if tree["op"] in LEAVES:
        yield tree


def fields(tree: dict) -> list[str]:
    return list(dict.fromkeys(leaf["field"] for leaf in walk(tree)))


def parameters(tree: dict) -> list[str]:
    """The codes whose change asks for the rule to be evaluated anew."""
    return list(dict.fromkeys(leaf["parameter"] for leaf in walk(tree) if "parameter" in leaf))


def parameter_name(code: str) -> str:
    return f"parameter {code}"


def with_parameters(facts: DataFrame, catalogue: DataFrame, codes: list[str], on: str) -> DataFrame:
    """facts with a column of each code's value on the row's day; null where the catalogue has none approved.

    The catalogue is (code, value, valid_from, valid_to, review), both ends inclusive, an open one null. Of several values the one that is
    valid since latest counts, then the greatest. Values are looked up once a day that occurs, and the days, at most a calendar's, joined
    to the facts."""
    days = facts.select(F.col(on).alias("_day")).distinct()
    held = catalogue.filter(F.col("code").isin(*codes) & F.col("review").isin("APPROVED", "PUBLISHED")).select("code", F.col("value").cast("string").try_cast(VALUE).alias("value"), "valid_from", "valid_to")
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_day"))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("_day")))
    newest = lambda c: F.max(F.when(F.col("code") == c, F.struct("valid_from", "value")))["value"].alias(parameter_name(c))
    found = days.join(held, valid).groupBy("_day").agg(*map(newest, codes))
    return facts.join(found, F.col(on) == F.col("_day"), "left").drop("_day")


def exact(c: Column, kind: str = SIDE) -> Column:
    return c.cast("string").try_cast(kind)


def truth(c: Column, kind: DataType) -> Column:
    """Whether a value says yes: numbers but 0, texts but the empty one, and each day."""
    return c if isinstance(kind, BooleanType) else c != 0 if isinstance(kind, NumericType) else c.isNotNull() if isinstance(kind, DateType) else c != ""


def compare(leaf: dict, schema: StructType) -> Column:
    """A leaf's comparison. Truth values are compared as such, days as days, and a number on either side makes it one of decimals; else texts
    are compared. What can't be read as the other side's kind is unknown."""
    field, kind, by = F.col(f"`{leaf['field']}`"), schema[leaf["field"]].dataType, COMPARATORS[leaf["cmp"]]
    if "parameter" in leaf:
        value = F.col(f"`{parameter_name(leaf['parameter'])}`")
        if leaf.get("factor") is not None:
            value = value * F.lit(str(leaf["factor"])).cast(FACTOR)
        return by(exact(field), value.try_cast(SIDE))
    value = leaf["value"]
    if value is None:
        return F.lit(None).cast("boolean")
    if isinstance(value, bool) or isinstance(kind, BooleanType):
        return by(truth(field, kind), F.lit(bool(value)))
    if isinstance(kind, DateType):
        return by(field, F.lit(str(value)).try_cast("date"))
    if isinstance(value, int | float) or isinstance(kind, NumericType):
        return by(exact(field), exact(F.lit(str(value))))
    return by(field.cast("string"), F.lit(str(value)))


def compiled(tree: dict, schema: StructType) -> Column:
    """true, false or null (unknown) of a checked tree over facts of a schema."""
    op = tree["op"]
    if op in TREES:
        parts = [compiled(t, schema) for t in tree["args"]]
        return ~parts[0] if op == "not" else reduce(Column.__and__ if op == "all" else Column.__or__, parts)
    field = F.col(f"`{tree['field']}`")
    if op == "in":
        return field.cast("string").isin(*map(str, tree["values"]))
    return compare(tree, schema) if op == "compare" else truth(field, schema[tree["field"]].dataType)


def verdicts(facts: DataFrame, rules: list[dict], key: list[str]) -> DataFrame:
    """key, verdict, questions, remedies for each row of facts, by the rules of one benefit (id, category, tree or null, review, exception_of).

    A rule without a tree or under review can't be executed: with any such rule of a deciding category the verdict is NEEDS_REVIEW. Else
    an unknown rule makes it NEEDS_DATA; else it is NOT_MET if an access rule fails or an exclusion holds and no exception of it holds;
    else MAY_APPLY. questions are the unknown rules' unknown fields, in order, once each; remedies (blocker, exception, state) name each
    exception of each blocker, or null where none is known. One pass over the facts, without a shuffle.
    """
    for r in rules:
        if r["tree"] is not None:
            check(r["tree"])
    runs = lambda r: r["tree"] is not None and not r.get("review")
    deciding = [r for r in rules if r["category"] in DECIDING]
    # a state a rule, written down before what is read from it, so that no tree is evaluated twice
    states = facts.select("*", *((state(compiled(r["tree"], facts.schema)) if runs(r) else F.lit("UNKNOWN")).alias(f"is {r['id']}") for r in deciding))
    now = {r["id"]: F.col(f"`is {r['id']}`") for r in deciding}
    exceptions = {r["id"]: [e for e in deciding if e["category"] == "EXCEPTION" and r["id"] in e.get("exception_of", [])] for r in deciding}
    blocks = {r["id"]: now[r["id"]] == ("FALSE" if r["category"] == "ACCESS" else "TRUE") for r in deciding if r["category"] != "EXCEPTION" and runs(r)}
    firm = [reduce(Column.__and__, (now[e["id"]] != "TRUE" for e in exceptions[k]), blocked) for k, blocked in blocks.items()]
    some = lambda cs: reduce(Column.__or__, cs, F.lit(False))
    verdict = F.when(some(now[r["id"]] == "UNKNOWN" for r in deciding), "NEEDS_DATA").when(some(firm), "NOT_MET").otherwise("MAY_APPLY")
    if not all(map(runs, deciding)):
        verdict = F.lit("NEEDS_REVIEW")
    asks = [F.when((now[r["id"]] == "UNKNOWN") & F.col(f"`{f}`").isNull(), F.lit(f)) for r in deciding if runs(r) for f in fields(r["tree"])]
    ways = [
        F.when(blocked, F.struct(F.lit(k).alias("blocker"), F.lit(e["id"] if e else None).cast("string").alias("exception"), (now[e["id"]] if e else F.lit(None).cast("string")).alias("state")))
        for k, blocked in blocks.items() for e in exceptions[k] or [None]
    ]
    none = F.array().cast("array<string>"), F.array().cast("array<struct<blocker:string,exception:string,state:string>>")
    questions = F.array_distinct(F.array_compact(F.array(*asks))) if asks else none[0]
    return states.select(*key, verdict.alias("verdict"), questions.alias("questions"), (F.array_compact(F.array(*ways)) if ways else none[1]).alias("remedies"))
