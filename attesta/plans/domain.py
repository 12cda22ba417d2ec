"""Domain queries: rules, gates, deadlines, diffs, graphs, text and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import graph, rules
from attesta.plans.registry import query
from attesta.plans.relational import FLOWS_SQL, PARTIES_SQL, flows, parties
from attesta.sources.tables import INCIDENTS_SQL, RELEASES_SQL, VERSIONS_SQL, incidents, releases, table, versions

FACTS_SQL = """facts AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 0 END AS solvent, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey < 5 END AS barred,
  CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal > 5000 END AS lifted, c_custkey % 31 <> 0 AS runs FROM customer)"""


def facts(spark, sf_dir):
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    return c.select(
        k.alias("id"), F.when(k % 5 != 0, F.col("c_acctbal") > 0).alias("solvent"), F.when(k % 7 != 0, F.col("c_nationkey") < 5).alias("barred"),
        F.when(k % 3 != 0, F.col("c_acctbal") > 5000).alias("lifted"), (k % 31 != 0).alias("runs"),
    )


@query("rule_verdicts", f"WITH {FACTS_SQL}, j AS (SELECT *, (NOT solvent OR barred) AND NOT lifted AS blocked FROM facts) SELECT id, CASE WHEN NOT runs THEN 'NEEDS_REVIEW' WHEN blocked IS NULL THEN 'NEEDS_DATA' WHEN blocked THEN 'BLOCKED' ELSE 'AVAILABLE' END AS verdict FROM j")
def rule_verdicts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select("id", rules.verdict(f["solvent"], f["barred"], f["lifted"], f["runs"]).alias("verdict"))


@query("rule_missing", f"WITH {FACTS_SQL} SELECT id, concat_ws(',', CASE WHEN solvent IS NULL THEN 'solvent' END, CASE WHEN barred IS NULL THEN 'barred' END, CASE WHEN lifted IS NULL THEN 'lifted' END) AS asks FROM facts WHERE solvent IS NULL OR barred IS NULL OR lifted IS NULL")
def rule_missing(spark, sf_dir):
    f = facts(spark, sf_dir)
    asks = rules.missing(solvent=f["solvent"], barred=f["barred"], lifted=f["lifted"])
    return f.select("id", F.array_join(asks, ",").alias("asks")).filter("asks <> ''")


@query("release_gates", f"""WITH {VERSIONS_SQL}, {INCIDENTS_SQL}, live AS (SELECT v.*, version_id IN (SELECT version_id FROM incidents WHERE severity = 'CRITICAL' AND state <> 'CLOSED') AS grave FROM versions v WHERE review_state = 'PUBLISHED')
SELECT 'VERIFIED' AS gate, count(*) FILTER (WHERE verified_on IS NULL) AS failures FROM live UNION ALL SELECT 'RESOLVED', count(*) FILTER (WHERE valid_kind IN ('UNKNOWN', 'CONDITIONAL')) FROM live
UNION ALL SELECT 'ORDERED', count(*) FILTER (WHERE valid_to < valid_from) FROM live UNION ALL SELECT 'NO_GRAVE_INCIDENT', count(*) FILTER (WHERE grave) FROM live""")
def release_gates(spark, sf_dir):
    grave = incidents(spark, sf_dir).filter("severity = 'CRITICAL' and state <> 'CLOSED'").select("version_id").distinct().withColumn("grave", F.lit(True))
    live = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'").join(grave, "version_id", "left")
    return rules.gates(live, {"VERIFIED": F.col("verified_on").isNull(), "RESOLVED": F.col("valid_kind").isin("UNKNOWN", "CONDITIONAL"), "ORDERED": F.col("valid_to") < F.col("valid_from"), "NO_GRAVE_INCIDENT": F.col("grave")})


@query("stopped_serving", f"""WITH {VERSIONS_SQL}, {RELEASES_SQL}, m AS (SELECT DISTINCT release_no, entity_id FROM versions JOIN releases USING (release_no) WHERE review_state = 'PUBLISHED' AND state = 'PUBLISHED'),
l AS (SELECT max(release_no) AS n FROM m), p AS (SELECT max(release_no) AS n FROM m WHERE release_no < (SELECT n FROM l))
SELECT entity_id FROM m WHERE release_no = (SELECT n FROM p) EXCEPT SELECT entity_id FROM m WHERE release_no = (SELECT n FROM l)""")
def stopped_serving(spark, sf_dir):
    served = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'").join(releases(spark, sf_dir).filter("state = 'PUBLISHED'"), "release_no", "left_semi")
    last = served.select("release_no").distinct().orderBy(F.desc("release_no")).limit(2)
    ends = last.agg(F.max("release_no").alias("now"), F.min("release_no").alias("before"))
    marked = served.join(F.broadcast(ends), F.col("release_no").between(F.col("before"), F.col("now")))  # ends is one row
    state = marked.groupBy("entity_id").agg(F.bool_or((F.col("release_no") == F.col("before")) & (F.col("before") < F.col("now"))).alias("was"), F.bool_or(F.col("release_no") == F.col("now")).alias("still"))
    return state.filter("was and not still").select("entity_id")


@query("business_deadline", """WITH days AS (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY))::DATE AS day), cal AS (SELECT day, isodow(day) < 6 AS open, sum((isodow(day) < 6)::INT) OVER (ORDER BY day) AS nth FROM days)
SELECT o_orderkey, e.day::VARCHAR AS due FROM orders JOIN cal s ON s.day = o_orderdate::DATE JOIN cal e ON e.open AND e.nth = s.nth + o_orderkey % 20 + 1""")
def business_deadline(spark, sf_dir):
    days = spark.sql("select explode(sequence(date'1994-12-01', date'2002-12-31')) day")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    found = rules.deadline(o, "start", F.col("o_orderkey") % 20 + 1, rules.business_days(days, "day"), "day")
    return found.select("o_orderkey", F.col("due").cast("string"))


UNITS_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
old AS (SELECT doc_id, place, unit FROM lines), new AS (SELECT doc_id - 1 AS doc_id, place, unit FROM lines WHERE doc_id - 1 IN (SELECT doc_id FROM documents)),
kept AS (SELECT * FROM old WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), stayed AS (SELECT doc_id, place, unit FROM kept INTERSECT SELECT doc_id, place, unit FROM new),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY place) AS turn FROM kept ANTI JOIN stayed USING (doc_id, place, unit)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY place) AS turn FROM new ANTI JOIN stayed USING (doc_id, place, unit)),
p AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.place AS was, b.place AS now FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.unit = b.unit AND a.turn = b.turn),
d AS (SELECT doc_id, place, 'SAME' AS change FROM stayed UNION ALL SELECT doc_id, now, 'MOVED' FROM p WHERE was IS NOT NULL AND now IS NOT NULL
  UNION ALL SELECT doc_id, place, CASE WHEN bool_or(o) AND bool_or(NOT o) THEN 'MODIFIED' WHEN bool_or(o) THEN 'REMOVED' ELSE 'ADDED' END FROM (SELECT doc_id, coalesce(was, now) AS place, was IS NOT NULL AS o FROM p WHERE was IS NULL OR now IS NULL) GROUP BY doc_id, place)"""


@query("unit_diff", f"WITH {UNITS_SQL} SELECT doc_id, change, count(*) AS n FROM d GROUP BY ALL")
def unit_diff(spark, sf_dir):
    """Each document against the one with the next id, line by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.select("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "unit"))
    old = lines.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi")
    new = lines.withColumn("doc_id", F.col("doc_id") - 1).join(ids, "doc_id", "left_semi")
    return rules.unit_diff(old, new, ["doc_id"]).groupBy("doc_id", "change").agg(F.count("*").alias("n"))


@query("graph_reach", f"""WITH RECURSIVE {FLOWS_SQL}, walk(root, node, depth) AS (SELECT a, b, 1 FROM flows UNION SELECT root, b, depth + 1 FROM walk JOIN flows ON a = node WHERE depth < 4)
SELECT root, node, min(depth)::INT AS depth FROM walk WHERE root <> node GROUP BY ALL""")
def graph_reach(spark, sf_dir):
    edges = flows(spark, sf_dir)
    return graph.reach(edges, edges.select(F.col("a").alias("root")).distinct(), 4)


@query("party_reach", f"""WITH RECURSIVE {PARTIES_SQL}, walk(root, node, depth) AS (SELECT a, b, 1 FROM flows WHERE a = (SELECT min(a) FROM flows) UNION SELECT root, b, depth + 1 FROM walk JOIN flows ON a = node WHERE depth < 4)
SELECT root, node, min(depth)::INT AS depth FROM walk WHERE root <> node GROUP BY ALL""")
def party_reach(spark, sf_dir):
    """From one customer, as pairs of all roots grow with the square of the graph."""
    edges = parties(spark, sf_dir)
    return graph.reach(edges, edges.agg(F.min("a").alias("root")), 4)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query("channel_extract", f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL}'))) AS email FROM documents")
def channel_extract(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email")).select("doc_id", F.lower("email").alias("email")).distinct()


@query("markup_clean", r"SELECT page_id, regexp_matches(html, '</?(p|div|span|table|ul|li|a|h[1-6])[ >]') AS marked, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[ >].*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS clean FROM pages")
def markup_clean(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[ >].*?</(script|style)>", " "), "<[^>]*>", " ")
    clean = F.sha2(F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")), 256)
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("</?(p|div|span|table|ul|li|a|h[1-6])[ >]").alias("marked"), clean.alias("clean"))


@query("content_versions", "SELECT sha256(text) AS content, count(*) AS captures, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("content"))
    return d.groupBy("content").agg(F.count("*").alias("captures"), F.min("doc_id").alias("first_id"))


@query("session_idle", "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY user_id")
def session_idle(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 30 minutes")
    fresh = F.when(near, 0).otherwise(1)
    return table(spark, sf_dir, "events").select("user_id", fresh.alias("fresh")).groupBy("user_id").agg(F.sum("fresh").alias("sessions"), F.count("*").alias("n"))


@query("retention_split", "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS purged, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS held FROM events GROUP BY event_type")
def retention_split(spark, sf_dir):
    old = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("held"))
