"""The dashboard's indicators: what blocks first, then what is missing, then what works."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import dashboard as D
from attesta.plans.registry import query
from attesta.sources.tables import INCIDENTS_SQL, VERSIONS_SQL, incidents, table, versions

MOST = 20
# fixed values: the weight of severities
WEIGHT = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2}
UNRELEASED = "review_state <> 'PUBLISHED'"


def indicators(spark, sf_dir):
    v, e = versions(spark, sf_dir), table(spark, sf_dir, "events")
    ends = e.agg(F.max("ts").alias("now"))  # one row
    last_day = e.join(F.broadcast(ends), F.col("ts") >= F.expr("now - interval 24 hours")).filter("event_type in ('error', 'signup')")
    weight = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in WEIGHT.items()), F.lit(3))
    rules = table(spark, sf_dir, "part").filter("p_size % 4 = 1").select(F.col("p_partkey").alias("rule"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_brand")).alias("benefit"), F.col("p_type").alias("category"))
    blocked = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("name"))
    places = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("jurisdiction"), F.col("c_name").alias("name"))
    row = ("entity_id", "version_no", "version_id")
    by_entity = (F.col("entity_id"), F.col("version_no"))
    return [
        D.Indicator("rules_unsigned", rules, (F.asc_nulls_last("benefit"), F.col("rule")), True),
        D.Indicator("incidents_open", incidents(spark, sf_dir).filter("state = 'OPEN'").select("severity", "version_id"), (weight, F.col("version_id")), True),
        D.Indicator("sources_blocked", blocked, (F.col("source"),)),
        D.Indicator("abstentions_last_day", last_day.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), F.col("event_type").alias("outcome"), F.col("event_id").alias("request")), (F.desc("moment"),)),
        D.Indicator("waiting_for_review", v.filter(f"{UNRELEASED} and review_state = 'CANDIDATE' and valid_kind <> 'UNKNOWN'").select(*row), by_entity, True),
        D.Indicator("without_interval", v.filter(f"{UNRELEASED} and valid_kind = 'UNKNOWN'").select(*row), by_entity, True),
        D.Indicator("places_published", places, (F.col("jurisdiction"), F.col("name"))),
        D.Indicator("versions_published", v.filter("review_state = 'PUBLISHED'").select(*row), by_entity),
    ]


def told_sql(*pairs: str) -> str:
    return "to_json({" + ", ".join(f"'{p}': {p}" for p in pairs) + "})"


ROW = told_sql("entity_id", "version_no", "version_id")
ROWS_SQL = f"""{VERSIONS_SQL}, {INCIDENTS_SQL}, i AS (
 SELECT 'rules_unsigned' AS indicator, true AS alarming, {told_sql('rule', 'benefit', 'category')} AS told, row_number() OVER (ORDER BY benefit NULLS LAST, rule) AS place FROM (SELECT p_partkey AS rule, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS benefit, p_type AS category FROM part WHERE p_size % 4 = 1) x
 UNION ALL SELECT 'incidents_open', true, {told_sql('severity', 'version_id')}, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, version_id, severity) FROM incidents WHERE state = 'OPEN'
 UNION ALL SELECT 'sources_blocked', false, {told_sql('source', 'name')}, row_number() OVER (ORDER BY source) FROM (SELECT s_suppkey AS source, s_name AS name FROM supplier WHERE s_acctbal < 0) x
 UNION ALL SELECT 'abstentions_last_day', false, {told_sql('moment', 'outcome', 'request')}, row_number() OVER (ORDER BY moment DESC, request) FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, event_type AS outcome, event_id AS request FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND event_type IN ('error', 'signup')) x
 UNION ALL SELECT 'waiting_for_review', true, {ROW}, row_number() OVER (ORDER BY entity_id, version_no) FROM versions WHERE review_state = 'CANDIDATE' AND valid_kind <> 'UNKNOWN'
 UNION ALL SELECT 'without_interval', true, {ROW}, row_number() OVER (ORDER BY entity_id, version_no) FROM versions WHERE review_state <> 'PUBLISHED' AND valid_kind = 'UNKNOWN'
 UNION ALL SELECT 'places_published', false, {told_sql('jurisdiction', 'name')}, row_number() OVER (ORDER BY jurisdiction, name) FROM (SELECT c_nationkey AS jurisdiction, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING') x
 UNION ALL SELECT 'versions_published', false, {ROW}, row_number() OVER (ORDER BY entity_id, version_no) FROM versions WHERE review_state = 'PUBLISHED')"""


ALARMS = {"rules_unsigned": True, "incidents_open": True, "sources_blocked": False, "abstentions_last_day": False, "waiting_for_review": True, "without_interval": True, "places_published": False, "versions_published": False}
NAMES_SQL = ", ".join(f"('{name}', {alarms})" for name, alarms in ALARMS.items())


@query("dashboard", f"""WITH {ROWS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY indicator) AS n FROM i) SELECT indicator, n, alarming, place::INT AS place, told::VARCHAR AS told FROM c WHERE place <= {MOST}
UNION ALL SELECT name, 0, alarms, NULL, NULL FROM (VALUES {NAMES_SQL}) t(name, alarms) WHERE name NOT IN (SELECT indicator FROM i)""")
def dashboard(spark, sf_dir):
    """Each indicator's number with its first rows; the report shows twenty, the number is that of all."""
    return D.dashboard(indicators(spark, sf_dir), MOST)


@query("quarantine_counts", f"""WITH {VERSIONS_SQL} SELECT 'waiting_for_review' AS indicator, count(*) FILTER (WHERE review_state = 'CANDIDATE' AND valid_kind <> 'UNKNOWN') AS n FROM versions
UNION ALL SELECT 'without_interval', count(*) FILTER (WHERE review_state <> 'PUBLISHED' AND valid_kind = 'UNKNOWN') FROM versions UNION ALL SELECT 'versions_published', count(*) FILTER (WHERE review_state = 'PUBLISHED') FROM versions""")
def quarantine_counts(spark, sf_dir):
    kinds = {"waiting_for_review": "review_state = 'CANDIDATE' and valid_kind <> 'UNKNOWN'", "without_interval": f"{UNRELEASED} and valid_kind = 'UNKNOWN'", "versions_published": "review_state = 'PUBLISHED'"}
    return D.counts({k: F.expr(c) for k, c in kinds.items()}, versions(spark, sf_dir))
