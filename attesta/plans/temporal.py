"""Temporal queries: serving, reasons, as-of values, periods, overlaps, validity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import temporal as t
from attesta.plans.registry import query
from attesta.sources.tables import EVALUATIONS_SQL, INCIDENTS_SQL, RELEASES_SQL, VERSIONS_SQL, evaluations, incidents, releases, table, versions

DAY, KNOWN = "1998-06-30", "1999-03-01"
#: The critical fields of each declared capability.
CRITICAL = {"1": ("population", "terms"), "2": ("terms",), "3": ("amount",), "4": ()}
CRITICAL_SQL = "critical(capability, field) AS (VALUES " + ", ".join(f"('{c}', '{f}')" for c, names in CRITICAL.items() for f in names) + ")"


def day(text: str):
    return F.lit(text).cast("date")


REASONS_SQL = f"""WITH {VERSIONS_SQL}, {RELEASES_SQL}, {INCIDENTS_SQL}, {EVALUATIONS_SQL}, {CRITICAL_SQL}, grave AS (
  SELECT DISTINCT version_id FROM incidents WHERE severity IN ('HIGH', 'CRITICAL') AND state IN ('OPEN', 'IN_REVIEW')),
judged AS (
  SELECT v.*, r.release_no IS NOT NULL AS released, g.version_id IS NOT NULL AS blocked, valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AS resolved
  FROM versions v LEFT JOIN releases r ON r.release_no = v.release_no AND r.state = 'PUBLISHED' LEFT JOIN grave g USING (version_id)),
reasons AS (
  SELECT version_id, 'NOT_PUBLISHED' AS reason FROM judged WHERE review_state <> 'PUBLISHED'
  UNION ALL SELECT version_id, 'NO_PUBLISHED_RELEASE' FROM judged WHERE NOT released
  UNION ALL SELECT version_id, 'NOT_KNOWN_THEN' FROM judged WHERE NOT (known_from <= DATE '{KNOWN}' AND (known_to IS NULL OR known_to > DATE '{KNOWN}'))
  UNION ALL SELECT version_id, 'RANGE_UNRESOLVED' FROM judged WHERE NOT resolved
  UNION ALL SELECT version_id, 'OUTSIDE_RANGE' FROM judged WHERE resolved AND NOT (DATE '{DAY}' >= valid_from AND (valid_to IS NULL OR DATE '{DAY}' <= valid_to))
  UNION ALL SELECT version_id, 'NOT_VERIFIED' FROM judged WHERE verified_on IS NULL
  UNION ALL SELECT version_id, 'STALE' FROM judged WHERE verified_on IS NOT NULL AND reverify_on <= DATE '{KNOWN}'
  UNION ALL SELECT version_id, 'GRAVE_INCIDENT' FROM judged WHERE blocked
  UNION ALL SELECT version_id, 'UNDECLARED_CAPABILITY' FROM judged WHERE capability NOT IN ('1', '2', '3', '4')
  UNION ALL SELECT version_id, 'FIELD_' || field || '_' || state FROM judged JOIN critical USING (capability) JOIN evaluations USING (version_id, field) WHERE state <> 'INFORMED'
  UNION ALL SELECT version_id, 'FIELD_' || field || '_NOT_EVALUATED' FROM judged JOIN critical USING (capability) ANTI JOIN evaluations USING (version_id, field))"""


def judged(spark, sf_dir):
    return t.with_reasons(versions(spark, sf_dir), releases(spark, sf_dir), incidents(spark, sf_dir), evaluations(spark, sf_dir), day(DAY), day(KNOWN), CRITICAL)


@query("temporal_serving", REASONS_SQL + " SELECT entity_id, version_id, version_no, valid_from::VARCHAR AS valid_from FROM judged j WHERE NOT EXISTS (SELECT 1 FROM reasons r WHERE r.version_id = j.version_id)")
def temporal_serving(spark, sf_dir):
    found = t.servable(versions(spark, sf_dir), releases(spark, sf_dir), incidents(spark, sf_dir), evaluations(spark, sf_dir), day(DAY), day(KNOWN), CRITICAL)
    return found.select("entity_id", "version_id", "version_no", F.col("valid_from").cast("string"))


@query("servable_reasons", REASONS_SQL + " SELECT version_id, reason FROM reasons")
def servable_reasons(spark, sf_dir):
    return judged(spark, sf_dir).select("version_id", F.explode("reasons").alias("reason"))


@query("reason_histogram", REASONS_SQL + " SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def reason_histogram(spark, sf_dir):
    return judged(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("range_contains", f"WITH {VERSIONS_SQL} SELECT version_id, valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AS resolved, valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND DATE '{DAY}' >= valid_from AND (valid_to IS NULL OR DATE '{DAY}' <= valid_to) AS holds FROM versions")
def range_contains(spark, sf_dir):
    return versions(spark, sf_dir).select("version_id", t.range_resolved().alias("resolved"), t.range_contains(day(DAY)).alias("holds"))


@query("known_at_snapshot", f"WITH {VERSIONS_SQL} SELECT entity_id, max(version_no) AS version_no, arg_max(version_id, version_no) AS version_id FROM versions WHERE known_from <= DATE '{KNOWN}' AND (known_to IS NULL OR known_to > DATE '{KNOWN}') GROUP BY entity_id")
def known_at_snapshot(spark, sf_dir):
    known = versions(spark, sf_dir).filter(t.known_at(day(KNOWN)))
    return known.groupBy("entity_id").agg(F.max("version_no").alias("version_no"), F.max_by("version_id", "version_no").alias("version_id"))


@query("current_release", f"WITH {RELEASES_SQL} SELECT release_no FROM releases WHERE state = 'PUBLISHED' AND published_on <= DATE '{KNOWN}' ORDER BY published_on DESC, release_no DESC LIMIT 1")
def current_release(spark, sf_dir):
    past = releases(spark, sf_dir).filter((F.col("state") == "PUBLISHED") & (F.col("published_on") <= day(KNOWN)))
    return past.orderBy(F.desc("published_on"), F.desc("release_no")).limit(1).select("release_no")


@query("release_visibility", f"WITH {VERSIONS_SQL}, {RELEASES_SQL} SELECT version_id, release_no FROM versions v WHERE EXISTS (SELECT 1 FROM releases r WHERE r.release_no = v.release_no AND r.state = 'PUBLISHED')")
def release_visibility(spark, sf_dir):
    return versions(spark, sf_dir).join(releases(spark, sf_dir).filter("state = 'PUBLISHED'"), "release_no", "left_semi").select("version_id", "release_no")


@query("critical_fields", f"""WITH {VERSIONS_SQL}, fields(capability, field) AS (VALUES ('1', 'population'), ('1', 'terms'), ('2', 'terms'), ('3', 'amount'))
SELECT version_id, v.capability, f.field, f.field IS NOT NULL AS declared FROM versions v LEFT JOIN fields f ON f.capability = v.capability""")
def critical_fields(spark, sf_dir):
    names = F.create_map(F.lit("1"), F.array(F.lit("population"), F.lit("terms")), F.lit("2"), F.array(F.lit("terms")), F.lit("3"), F.array(F.lit("amount")))
    rows = versions(spark, sf_dir).select("version_id", "capability", F.explode_outer(names[F.col("capability")]).alias("field"))
    return rows.withColumn("declared", F.col("field").isNotNull())


@query("term_state", f"""WITH {VERSIONS_SQL} SELECT version_id, CASE WHEN valid_kind = 'UNKNOWN' THEN 'UNKNOWN' WHEN DATE '{DAY}' < valid_from THEN 'NOT_STARTED'
WHEN valid_to < DATE '{DAY}' THEN 'CLOSED' ELSE 'OPEN' END AS state FROM versions""")
def term_state(spark, sf_dir):
    state = F.when(F.col("valid_kind") == "UNKNOWN", "UNKNOWN").when(day(DAY) < F.col("valid_from"), "NOT_STARTED").when(F.col("valid_to") < day(DAY), "CLOSED").otherwise("OPEN")
    return versions(spark, sf_dir).select("version_id", state.alias("state"))


PRICES_SQL = """prices AS (SELECT l_partkey AS part, l_shipdate::DATE AS day, max(round(l_extendedprice / l_quantity * 100)::BIGINT) AS cents
  FROM lineitem GROUP BY ALL), periods AS (SELECT part, cents, day AS valid_from, lead(day) OVER (PARTITION BY part ORDER BY day) - 1 AS valid_to FROM prices)"""


def prices(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    dated = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day")).agg(F.max(cents).alias("cents"))
    return t.periods(dated, "part", "day", "cents")


@query("value_periods", f"WITH {PRICES_SQL} SELECT part, cents, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM periods")
def value_periods(spark, sf_dir):
    return prices(spark, sf_dir).select("part", "cents", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query("asof_value", f"WITH {PRICES_SQL} SELECT part, cents FROM periods WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')")
def asof_value(spark, sf_dir):
    return t.as_of(prices(spark, sf_dir), day(DAY)).select("part", "cents")


@query("asof_join", f"""WITH {PRICES_SQL} SELECT p_partkey, o.q, periods.cents FROM part CROSS JOIN (VALUES (DATE '1996-01-01'), (DATE '1998-01-01'), (DATE '2000-01-01')) o(q)
JOIN periods ON periods.part = p_partkey AND o.q >= valid_from AND (valid_to IS NULL OR o.q <= valid_to)""".replace("o.q,", "o.q::VARCHAR AS q,", 1))
def asof_join(spark, sf_dir):
    dates = F.explode(F.array(*(day(d) for d in ("1996-01-01", "1998-01-01", "2000-01-01"))))
    asked = table(spark, sf_dir, "part").select("p_partkey", dates.alias("q"))
    p = prices(spark, sf_dir)
    held = (F.col("q") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("q") <= F.col("valid_to")))
    return asked.join(p, (asked["p_partkey"] == p["part"]) & held).select("p_partkey", F.col("q").cast("string"), "cents")


@query("overlap_check", f"""WITH {VERSIONS_SQL}, live AS (SELECT *, coalesce(valid_to, DATE '9999-12-31') AS ends FROM versions WHERE review_state = 'PUBLISHED' AND valid_kind IN ('CLOSED', 'OPEN_END'))
SELECT version_id FROM live a WHERE EXISTS (SELECT 1 FROM live b WHERE b.entity_id = a.entity_id AND (b.valid_from, b.version_id) < (a.valid_from, a.version_id) AND b.ends >= a.valid_from)""")
def overlap_check(spark, sf_dir):
    live = versions(spark, sf_dir).filter((F.col("review_state") == "PUBLISHED") & t.range_resolved())
    return t.first_overlaps(live, ["entity_id"], "version_id").select("version_id")


@query("scd2_close", """SELECT o_custkey AS entity_id, o_orderkey AS version_id, o_orderdate::DATE::VARCHAR AS known_from,
lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::VARCHAR AS known_to FROM orders""")
def scd2_close(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("version_id"), d.cast("string").alias("known_from"), F.lead(d).over(w).cast("string").alias("known_to"))


@query("best_state_coverage", """SELECT o_custkey AS entity_id, CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS best,
count(*) FILTER (WHERE o_orderstatus = 'F') AS informed, count(*) AS evaluated FROM orders GROUP BY o_custkey""")
def best_state_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id"))
    return o.agg(t.best_state("o_orderstatus", ("F", "O", "P")).alias("best"), F.count_if(F.col("o_orderstatus") == "F").alias("informed"), F.count("*").alias("evaluated"))


@query("validity_verdict", """WITH e AS (SELECT o_orderkey AS id, o_orderstatus AS state, o_orderdate::DATE AS published, coalesce(bool_or(l_returnflag = 'R'), false) AS closing, coalesce(bool_or(l_returnflag = 'A'), false) AS reopening, count(l_orderkey) AS evidence
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, CASE WHEN closing AND reopening THEN 'REVIEW_CLOSED_AND_REOPENED' WHEN closing THEN 'REVIEW_CLOSED' WHEN id % 17 = 0 THEN 'REVIEW_NO_DATE' WHEN state = 'F' AND evidence > 0 THEN 'OPEN_END' WHEN state = 'P' THEN 'REVIEW_NOT_IN_FORCE' ELSE 'REVIEW_NO_EVIDENCE' END AS verdict,
CASE WHEN NOT closing AND id % 17 <> 0 AND state = 'F' AND evidence > 0 THEN (published + 8)::VARCHAR END AS applies_from FROM e""")
def validity_verdict(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("c"), F.bool_or(F.col("l_returnflag") == "A").alias("r"), F.count("*").alias("evidence"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.to_date("o_orderdate").alias("published")).join(li, "id", "left")
    closing, reopening, evidence = F.coalesce("c", F.lit(False)), F.coalesce("r", F.lit(False)), F.coalesce("evidence", F.lit(0))
    verdict = (
        F.when(closing & reopening, "REVIEW_CLOSED_AND_REOPENED").when(closing, "REVIEW_CLOSED").when(F.col("id") % 17 == 0, "REVIEW_NO_DATE")
        .when((F.col("state") == "F") & (evidence > 0), "OPEN_END").when(F.col("state") == "P", "REVIEW_NOT_IN_FORCE").otherwise("REVIEW_NO_EVIDENCE")
    )
    return o.select("id", verdict.alias("verdict"), F.when(verdict == "OPEN_END", F.date_add("published", 8)).cast("string").alias("applies_from"))


@query("derived_validity", f"""WITH {VERSIONS_SQL} SELECT entity_id, CASE WHEN bool_or(valid_kind = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_or(valid_kind = 'CONDITIONAL') THEN 'CONDITIONAL' WHEN bool_or(valid_kind = 'CLOSED') THEN 'CLOSED' ELSE 'OPEN_END' END AS kind,
CASE WHEN NOT bool_or(valid_kind IN ('UNKNOWN', 'CONDITIONAL')) THEN min(valid_from)::VARCHAR END AS valid_from, CASE WHEN NOT bool_or(valid_kind IN ('UNKNOWN', 'CONDITIONAL')) AND bool_or(valid_kind = 'CLOSED') THEN max(valid_to)::VARCHAR END AS valid_to FROM versions GROUP BY entity_id""")
def derived_validity(spark, sf_dir):
    has = lambda k: F.bool_or(F.col("valid_kind") == k)
    g = versions(spark, sf_dir).groupBy("entity_id").agg(has("UNKNOWN").alias("u"), has("CONDITIONAL").alias("c"), has("CLOSED").alias("z"), F.min("valid_from").alias("f"), F.max("valid_to").alias("e"))
    known = ~F.col("u") & ~F.col("c")
    kind = F.when(F.col("u"), "UNKNOWN").when(F.col("c"), "CONDITIONAL").when(F.col("z"), "CLOSED").otherwise("OPEN_END")
    return g.select("entity_id", kind.alias("kind"), F.when(known, F.col("f")).cast("string").alias("valid_from"), F.when(known & F.col("z"), F.col("e")).cast("string").alias("valid_to"))


@query("verification_stamp", f"WITH {VERSIONS_SQL} SELECT entity_id, min(verified_on)::VARCHAR AS verified_on, (min(verified_on) + 30)::VARCHAR AS reverify_on, count(*) FILTER (WHERE verified_on IS NULL) AS uncaptured FROM versions GROUP BY entity_id")
def verification_stamp(spark, sf_dir):
    first = F.min("verified_on")
    return versions(spark, sf_dir).groupBy("entity_id").agg(first.cast("string").alias("verified_on"), F.date_add(first, 30).cast("string").alias("reverify_on"), F.count_if(F.col("verified_on").isNull()).alias("uncaptured"))
