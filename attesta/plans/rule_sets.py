"""Rule sets as data: verdicts, benefits, remedies, cases and next questions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attesta.operators import rule_sets as R
from attesta.plans.registry import query
from attesta.sources.tables import table

#: A benefit's rules as they would be stored: access rules must all hold; an exception lifts the access rule that it names.
RULES = json.loads("""[
 {"id": "balance", "kind": "ACCESS", "tree": {"op": "compare", "field": "balance", "by": "ge", "parameter": "floor"}},
 {"id": "segment", "kind": "ACCESS", "tree": {"op": "any", "of": [{"op": "in", "field": "segment", "values": ["FURNITURE", "BUILDING"]},
   {"op": "compare", "field": "orders", "by": "gt", "value": 12}]}},
 {"id": "not_foreign", "kind": "ACCESS", "tree": {"op": "not", "of": [{"op": "all", "of": [{"op": "is_true", "field": "foreign"}, {"op": "compare", "field": "orders", "by": "lt", "value": 5}]}]}},
 {"id": "loyal", "kind": "EXCEPTION", "of": "balance", "tree": {"op": "compare", "field": "orders", "by": "ge", "value": 15}}
]""")
PARAMETERS = {"floor": 1000.0}
FACTS_SQL = """f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN coalesce(n, 0) END AS orders,
 CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey < 8 END AS foreign_ FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
v AS (SELECT c_custkey, balance, segment, orders, foreign_, balance >= 1000 AS b, segment IN ('FURNITURE', 'BUILDING') OR orders > 12 AS s, NOT (foreign_ AND orders < 5) AS x, orders >= 15 AS l FROM f)"""
STATE_SQL = "CASE WHEN {0} THEN 'TRUE' WHEN NOT {0} THEN 'FALSE' ELSE 'UNKNOWN' END"
STATES_SQL = f"{FACTS_SQL}, st AS (SELECT c_custkey, balance, segment, orders, foreign_, " + ", ".join(f"{STATE_SQL.format(c)} AS {c}" for c in "bsxl") + " FROM v)"
IDS_SQL = "(VALUES ('balance', 'b'), ('segment', 's'), ('not_foreign', 'x'), ('loyal', 'l'))"


def facts(spark, sf_dir):
    """What is known of each customer; null: not known."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.expr("o_custkey = c_custkey"), "left")
    return c.selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END balance", "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END segment",
        "CASE WHEN c_custkey % 5 <> 0 THEN coalesce(n, 0) END orders", "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey < 8 END foreign",
    )


def states(spark, sf_dir):
    """A row for each customer, with a column of each rule's state: one pass over the facts."""
    return facts(spark, sf_dir).select("*", *(R.state(R.compile_rule(r["tree"], PARAMETERS)).alias(f"is_{r['id']}") for r in RULES))


@query("rule_set_states", f"WITH {STATES_SQL} SELECT c_custkey, id AS rule_id, CASE id WHEN 'balance' THEN b WHEN 'segment' THEN s WHEN 'not_foreign' THEN x ELSE l END AS state FROM st, {IDS_SQL} r(id, k)")
def rule_set_states(spark, sf_dir):
    each = F.array(*(F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"is_{r['id']}").alias("state")) for r in RULES))
    return states(spark, sf_dir).select("c_custkey", F.inline(each))


def lifted():
    """The states of access rules after exceptions: an exception that holds lifts its rule, one that is unknown leaves a failed rule open."""
    out = {}
    for r in (r for r in RULES if r["kind"] == "ACCESS"):
        s = F.col(f"is_{r['id']}")
        for e in (e for e in RULES if e.get("of") == r["id"]):
            x = F.col(f"is_{e['id']}")
            s = F.when((s == "TRUE") | (x == "TRUE"), "TRUE").when((s == "UNKNOWN") | (x == "UNKNOWN"), "UNKNOWN").otherwise("FALSE")
        out[r["id"]] = s
    return out


LIFTED_SQL = f"{STATES_SQL}, lf AS (SELECT c_custkey, CASE WHEN b = 'TRUE' OR l = 'TRUE' THEN 'TRUE' WHEN b = 'UNKNOWN' OR l = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'FALSE' END AS b, s, x FROM st)"


@query("benefit_verdicts", f"WITH {LIFTED_SQL} SELECT c_custkey, CASE WHEN 'FALSE' IN (b, s, x) THEN 'NOT_ELIGIBLE' WHEN 'UNKNOWN' IN (b, s, x) THEN 'MISSING_FACTS' ELSE 'ELIGIBLE' END AS verdict FROM lf")
def benefit_verdicts(spark, sf_dir):
    """One failed access rule decides; else one unknown leaves the verdict open."""
    all_states = F.array(*lifted().values())
    verdict = F.when(F.array_contains(all_states, "FALSE"), "NOT_ELIGIBLE").when(F.array_contains(all_states, "UNKNOWN"), "MISSING_FACTS").otherwise("ELIGIBLE")
    return states(spark, sf_dir).select("c_custkey", verdict.alias("verdict"))


@query(
    "remediation",
    f"""WITH {STATES_SQL} SELECT c_custkey, 'balance' AS blocker, 'loyal' AS exception, l AS exception_state FROM st WHERE b = 'FALSE' AND l <> 'TRUE'
UNION ALL SELECT c_custkey, 'segment', NULL, NULL FROM st WHERE s = 'FALSE' UNION ALL SELECT c_custkey, 'not_foreign', NULL, NULL FROM st WHERE x = 'FALSE'""",
)
def remediation(spark, sf_dir):
    """Each failed access rule that nothing lifts, with each of its exceptions and its state; a rule without exceptions has one row."""
    rows = []
    for r in (r for r in RULES if r["kind"] == "ACCESS"):
        exceptions = [e["id"] for e in RULES if e.get("of") == r["id"]]
        stands = (F.col(f"is_{r['id']}") == "FALSE") & (lifted()[r["id"]] != "TRUE")
        for e in exceptions or [None]:
            known = F.col(f"is_{e}") if e else F.lit(None).cast("string")
            rows.append(F.when(stands, F.struct(F.lit(r["id"]).alias("blocker"), F.lit(e).cast("string").alias("exception"), known.alias("exception_state"))))
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return states(spark, sf_dir).select("c_custkey", F.inline(found))


@query(
    "next_questions",
    f"""WITH {STATES_SQL}, q AS (SELECT c_custkey, 'balance' AS field FROM st WHERE b = 'UNKNOWN' AND balance IS NULL UNION ALL SELECT c_custkey, 'segment' FROM st WHERE s = 'UNKNOWN' AND segment IS NULL
 UNION ALL SELECT c_custkey, 'orders' FROM st WHERE orders IS NULL AND (s = 'UNKNOWN' OR x = 'UNKNOWN' OR l = 'UNKNOWN') UNION ALL SELECT c_custkey, 'foreign' FROM st WHERE x = 'UNKNOWN' AND foreign_ IS NULL)
SELECT field, count(*) AS asked FROM q GROUP BY field""",
)
def next_questions(spark, sf_dir):
    """How many customers each field would be asked of: those for whom a rule with that field is unknown for want of it."""
    missing = [R.missing(r["tree"], R.compile_rule(r["tree"], PARAMETERS)) for r in RULES]
    asked = facts(spark, sf_dir).select(F.explode(F.array_distinct(F.flatten(F.array(*missing)))).alias("field"))
    return asked.groupBy("field").agg(F.count("*").alias("asked"))


CASES = [
    ("rich", "balance", 2000.0, None, None, None, "TRUE"), ("poor", "balance", 10.0, None, None, None, "FALSE"), ("no balance", "balance", None, None, None, None, "UNKNOWN"),
    ("by segment", "segment", None, "BUILDING", None, None, "TRUE"), ("segment or orders", "segment", None, None, 3, None, "UNKNOWN"), ("neither", "segment", None, "TOYS", 3, None, "FALSE"),
    ("at home", "not_foreign", None, None, None, False, "TRUE"), ("abroad and new", "not_foreign", None, None, 2, True, "FALSE"), ("abroad", "not_foreign", None, None, None, True, "UNKNOWN"),
    ("loyal at 15", "loyal", None, None, 15, None, "TRUE"),
]


@query("rule_cases", "SELECT * FROM (VALUES ('balance', 3, 3), ('loyal', 1, 1), ('not_foreign', 3, 3), ('segment', 3, 3)) t(rule_id, cases, passed)")
def rule_cases(spark, sf_dir):
    """For each rule, how many cases it carries and how many of them come out as they say."""
    cases = spark.createDataFrame(CASES, "name string, rule_id string, balance double, segment string, orders long, foreign boolean, want string")
    got = F.coalesce(*(F.when(F.col("rule_id") == r["id"], R.state(R.compile_rule(r["tree"], PARAMETERS))) for r in RULES))
    return cases.groupBy("rule_id").agg(F.count("*").cast("int").alias("cases"), F.count_if(got == F.col("want")).cast("int").alias("passed"))
