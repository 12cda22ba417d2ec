"""Two benefits' stored rules over customers, with parameters that change from day to day."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attesta.operators import rule_contract as R
from attesta.plans.registry import query
from attesta.plans.rule_sets import facts as known
from attesta.sources.tables import table

RULES = json.loads("""[
 {"id": "balance", "category": "ACCESS", "tree": {"schema_version": "1.0", "op": "compare", "field": "balance", "cmp": ">=", "parameter": "FLOOR", "factor": "1.5", "unit": "ARS"}},
 {"id": "segment", "category": "ACCESS", "tree": {"schema_version": "1.0", "op": "any", "args": [{"op": "in", "field": "segment", "values": ["FURNITURE", "BUILDING", "TOYS"]}, {"op": "compare", "field": "orders", "cmp": ">", "value": "12", "unit": "cantidad"}]}},
 {"id": "foreign", "category": "EXCLUSION", "tree": {"schema_version": "1.0", "op": "all", "args": [{"op": "is_true", "field": "foreign"}, {"op": "not", "args": [{"op": "compare", "field": "asked_on", "cmp": ">=", "value": "1998-01-01", "unit": "fecha"}]}]}},
 {"id": "loyal", "category": "EXCEPTION", "exception_of": ["balance", "foreign"], "tree": {"schema_version": "1.0", "op": "compare", "field": "orders", "cmp": ">=", "value": 9.5, "unit": "cantidad"}},
 {"id": "told", "category": "SAFEGUARD", "tree": null},
 {"id": "later", "category": "REVOCATION", "review": true, "tree": {"schema_version": "1.0", "op": "is_true", "field": "foreign"}}
]""")
#: The second benefit has one rule more, whose tree nobody has approved.
BENEFITS = {"first": RULES, "second": [*RULES, {"id": "new", "category": "EXCLUSION", "review": True, "tree": {"schema_version": "1.0", "op": "is_true", "field": "foreign"}}]}


def parameter_values(spark, sf_dir):
    """A floor for 60 of each 80 days, of which one in five isn't approved."""
    n = F.col("n_nationkey").cast("int")
    since = F.date_add(F.lit("1995-01-01").cast("date"), 80 * n)
    return table(spark, sf_dir, "nation").select(F.lit("FLOOR").alias("code"), F.concat(100 * n, F.lit(".25")).alias("value"), since.alias("valid_from"), F.date_add(since, 59).alias("valid_to"), F.when(n % 5 == 0, "CANDIDATE").otherwise("APPROVED").alias("review"))


def facts_on(spark, sf_dir):
    """What is known of each customer, with the day of asking and that day's floor."""
    asked = known(spark, sf_dir).withColumn("asked_on", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")))
    return R.with_parameters(asked, parameter_values(spark, sf_dir), ["FLOOR"], "asked_on")


@query("contract_verdicts", """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN coalesce(n, 0) END AS orders,
 CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey < 8 END AS fo, DATE '1995-01-01' + (c_custkey % 2000)::INT AS day FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
p AS (SELECT n_nationkey * 100 + 0.25 AS v, DATE '1995-01-01' + (80 * n_nationkey)::INT AS a FROM nation WHERE n_nationkey % 5 <> 0),
b AS (SELECT f.*, balance >= v * 1.5 AS b, segment IN ('FURNITURE', 'BUILDING', 'TOYS') OR orders > 12 AS s, fo AND NOT day >= DATE '1998-01-01' AS x, orders >= 9.5 AS l FROM f LEFT JOIN p ON day BETWEEN a AND a + 59),
o AS (SELECT *, CASE WHEN l IS NULL THEN 'UNKNOWN' WHEN l THEN 'TRUE' ELSE 'FALSE' END AS ls FROM b),
r AS (SELECT c_custkey, CASE WHEN b IS NULL OR s IS NULL OR x IS NULL OR l IS NULL THEN 'NEEDS_DATA' WHEN NOT s OR ((NOT b OR x) AND NOT l) THEN 'NOT_MET' ELSE 'MAY_APPLY' END AS verdict,
 concat_ws(',', CASE WHEN b IS NULL AND balance IS NULL THEN 'balance' END, CASE WHEN s IS NULL AND segment IS NULL THEN 'segment' END, CASE WHEN s IS NULL AND orders IS NULL THEN 'orders' END, CASE WHEN x IS NULL AND fo IS NULL THEN 'foreign' END, CASE WHEN s IS NOT NULL AND orders IS NULL THEN 'orders' END) AS questions,
 concat_ws(',', CASE WHEN NOT b THEN 'balance/loyal/' || ls END, CASE WHEN NOT s THEN 'segment' END, CASE WHEN x THEN 'foreign/loyal/' || ls END) AS remedies FROM o)
SELECT c_custkey, benefit, CASE benefit WHEN 'second' THEN 'NEEDS_REVIEW' ELSE verdict END AS verdict, questions, remedies FROM r, (VALUES ('first'), ('second')) t(benefit)""")
def contract_verdicts(spark, sf_dir):
    """Each customer's verdict on both benefits, what to ask and which exceptions there are, on the day of asking."""
    facts = facts_on(spark, sf_dir)
    found = [R.verdicts(facts, rules, ["c_custkey"]).withColumn("benefit", F.lit(b)) for b, rules in BENEFITS.items()]
    ways = F.transform("remedies", lambda x: F.concat_ws("/", x["blocker"], x["exception"], x["state"]))
    return found[0].unionByName(found[1]).select("c_custkey", "benefit", "verdict", F.array_join("questions", ",").alias("questions"), F.array_join(ways, ",").alias("remedies"))
