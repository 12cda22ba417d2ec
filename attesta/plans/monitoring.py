"""Monitoring, releases, graphs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import stateful
from attesta.plans.registry import query
from attesta.plans.relational import FLOWS_SQL, flows
from attesta.sources.tables import INCIDENTS_SQL, RELEASES_SQL, VERSIONS_SQL, incidents, releases, table, versions
from attesta.streaming import events as stream

NOW = "2024-01-31 00:00:00"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query("rate_limiter")
def rate_limiter(spark, sf_dir):
    """Each user's events as requests under 3 an hour."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("origin"), seconds().alias("at"))
    return stateful.rate_limit(e, 3, 3600.0)


@query("lease_replay")
def lease_replay(spark, sf_dir):
    """Users claiming their event's type for 30 minutes."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), F.col("event_type").alias("resource"), F.col("user_id").alias("holder"), seconds().alias("at"))
    return stateful.leases(e, 1800.0)


@query("due_planner", f"""WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error' AND value > 15) AS last_ok, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)
SELECT user_id, last_type, last_ok IS NULL AS never_run, CASE WHEN last_ok IS NULL THEN NULL ELSE date_diff('day', last_ok::DATE, DATE '2024-01-31') END AS days FROM u WHERE last_ok IS NULL OR last_ok < TIMESTAMP '{NOW}' - INTERVAL 2 DAY""")
def due_planner(spark, sf_dir):
    """Sources without a good run in the last two days; those that never ran come first in a plan ordered by never_run."""
    good = (F.col("event_type") != "error") & (F.col("value") > 15)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(good, F.col("ts"))).alias("last_ok"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    due = u.filter(F.col("last_ok").isNull() | (F.col("last_ok") < F.lit(NOW).cast("timestamp") - F.expr("interval 2 days")))
    return due.select("user_id", "last_type", F.col("last_ok").isNull().alias("never_run"), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("last_ok")).cast("long").alias("days"))


@query("outbox_pending", """WITH k AS (SELECT user_id, event_type, ts::DATE::VARCHAR AS day, min(event_id) AS event_id, count(*) AS attempts FROM events GROUP BY ALL)
SELECT user_id, event_type, day, event_id, attempts, CASE WHEN event_type = 'purchase' THEN 'SENT' WHEN attempts > 8 THEN 'DEAD' ELSE 'PENDING' END AS state FROM k""")
def outbox_pending(spark, sf_dir):
    """Messages by idempotency key, with their attempts; more than eight without success are dead."""
    k = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").cast("string").alias("day")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("attempts"))
    return k.withColumn("state", F.when(F.col("event_type") == "purchase", "SENT").when(F.col("attempts") > 8, "DEAD").otherwise("PENDING"))


@query("feedback_summary", "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value < 5) AS low FROM events GROUP BY ALL")
def feedback_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < 5).alias("low"))


@query("session_facts", """WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS met FROM events GROUP BY ALL), s AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id)
SELECT user_id, event_type, CASE WHEN value < 2 THEN 'REFUSED' WHEN met < seen - INTERVAL 2 HOUR THEN 'EXPIRED' ELSE 'HELD' END AS state FROM l JOIN s USING (user_id)""")
def session_facts(spark, sf_dir):
    """The last value of each fact of a session, or why there is none: refused, or older than the session may live."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))
    seen = F.max("at").over(Window.partitionBy("user_id"))
    old = F.col("at") < seen - F.expr("interval 2 hours")
    return last.select("user_id", "event_type", F.when(F.col("value") < 2, "REFUSED").when(old, "EXPIRED").otherwise("HELD").alias("state"))


@query("stream_daily", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS starts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    counts = stream.drain(stream.window_counts(stream.read(spark, f"{sf_dir}/events.parquet"), "1 day", "1 hour"), "complete")
    return counts.select("event_type", F.col("starts").cast("timestamp_ntz").alias("starts"), "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS turn FROM x), z AS (SELECT user_id, turn, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM y GROUP BY ALL)
SELECT user_id, starts::TIMESTAMP AS starts, ends::TIMESTAMP AS ends, n FROM z WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, each sent once; those still open when the stream ends stay in its state."""
    closed = stream.drain(stream.sessions(stream.read(spark, f"{sf_dir}/events.parquet"), "30 minutes", "1 hour"), "append")
    return closed.select("user_id", F.col("starts").cast("timestamp_ntz").alias("starts"), F.col("ends").cast("timestamp_ntz").alias("ends"), "n")


@query("stream_outbox", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY ALL")
def stream_outbox(spark, sf_dir):
    """Every event reaches the sink once by its idempotency key."""
    sent = stream.drain(stream.outbox(stream.read(spark, f"{sf_dir}/events.parquet"), ["event_id"], "1 day"), "append")
    return sent.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("quarantine", f"""WITH {VERSIONS_SQL}, {INCIDENTS_SQL}, g AS (SELECT DISTINCT version_id FROM incidents WHERE severity IN ('HIGH', 'CRITICAL') AND state <> 'CLOSED')
SELECT v.version_id, concat_ws(',', CASE WHEN review_state = 'CANDIDATE' THEN 'NOT_REVIEWED' END, CASE WHEN verified_on IS NULL THEN 'NOT_VERIFIED' END, CASE WHEN valid_kind IN ('UNKNOWN', 'CONDITIONAL') THEN 'RANGE_UNRESOLVED' END, CASE WHEN g.version_id IS NOT NULL THEN 'GRAVE_INCIDENT' END) AS reasons
FROM versions v LEFT JOIN g ON g.version_id = v.version_id WHERE review_state <> 'PUBLISHED'""")
def quarantine(spark, sf_dir):
    """All that isn't published, with every reason; none means it waits for its release only."""
    grave = incidents(spark, sf_dir).filter("severity in ('HIGH', 'CRITICAL') and state <> 'CLOSED'").select("version_id").distinct().withColumn("grave", F.lit(True))
    v = versions(spark, sf_dir).filter("review_state <> 'PUBLISHED'").join(grave, "version_id", "left")
    cases = ((F.col("review_state") == "CANDIDATE", "NOT_REVIEWED"), (F.col("verified_on").isNull(), "NOT_VERIFIED"), (F.col("valid_kind").isin("UNKNOWN", "CONDITIONAL"), "RANGE_UNRESOLVED"), (F.col("grave"), "GRAVE_INCIDENT"))
    return v.select("version_id", F.concat_ws(",", *(F.when(c, name) for c, name in cases)).alias("reasons"))


@query("release_inherit", f"""WITH {VERSIONS_SQL}, {RELEASES_SQL}, p AS (SELECT entity_id, release_no, max(version_id) AS version_id FROM versions JOIN releases USING (release_no) WHERE review_state = 'PUBLISHED' AND state = 'PUBLISHED' GROUP BY ALL)
SELECT entity_id, max(release_no)::INT AS from_release, arg_max(version_id, release_no) AS version_id, max(release_no) < (SELECT max(release_no) FROM p) AS inherited FROM p GROUP BY entity_id""")
def release_inherit(spark, sf_dir):
    """The newest release with all it inherits: each entity's version of the last release that replaced it."""
    live = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'").join(releases(spark, sf_dir).filter("state = 'PUBLISHED'"), "release_no", "left_semi")
    newest = F.broadcast(live.agg(F.max("release_no").alias("newest")))  # one row
    own = live.groupBy("entity_id").agg(F.max(F.struct("release_no", "version_id")).alias("m"))
    return own.join(newest, how="cross").select("entity_id", F.col("m.release_no").alias("from_release"), F.col("m.version_id").alias("version_id"), (F.col("m.release_no") < F.col("newest")).alias("inherited"))


@query("approval_queue", f"""WITH {VERSIONS_SQL}, {INCIDENTS_SQL} SELECT version_id, entity_id FROM versions WHERE review_state = 'CANDIDATE' AND valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND version_id NOT IN (SELECT version_id FROM incidents WHERE state <> 'CLOSED')""")
def approval_queue(spark, sf_dir):
    open_ = incidents(spark, sf_dir).filter("state <> 'CLOSED'").select("version_id")
    return versions(spark, sf_dir).filter("review_state = 'CANDIDATE' and valid_kind not in ('UNKNOWN', 'CONDITIONAL')").join(open_, "version_id", "left_anti").select("version_id", "entity_id")


@query("graph_cycles", f"""WITH RECURSIVE {FLOWS_SQL}, walk(root, node, path) AS (SELECT a, b, [a, b] FROM flows WHERE b >= a UNION ALL SELECT root, f.b, list_append(path, f.b) FROM walk JOIN flows f ON f.a = node WHERE node <> root AND len(path) <= 4 AND f.b >= root AND (f.b = root OR NOT list_contains(path, f.b)))
SELECT (len(path) - 1)::INT AS hops, count(*) AS cycles FROM walk WHERE node = root GROUP BY ALL""")
def graph_cycles(spark, sf_dir):
    """Simple cycles of up to four hops, each once, from its smallest node."""
    edges = flows(spark, sf_dir).select("a", "b")
    paths = edges.filter("b >= a").select(F.col("a").alias("root"), F.col("b").alias("node"), F.array("a", "b").alias("path"))
    found = paths.filter("node = root")
    for _ in range(3):
        nxt = paths.filter("node <> root").join(edges, F.col("node") == F.col("a")).filter((F.col("b") == F.col("root")) | ((F.col("b") > F.col("root")) & ~F.array_contains("path", F.col("b"))))
        paths = nxt.select("root", F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"))
        found = found.unionByName(paths.filter("node = root"))
    return found.groupBy((F.size("path") - 1).alias("hops")).agg(F.count("*").alias("cycles"))


@query("graph_report", f"""WITH {FLOWS_SQL} SELECT (SELECT count(*) FROM flows) AS relations, (SELECT count(*) FROM (SELECT a FROM flows UNION SELECT b FROM flows)) AS nodes, (SELECT count(*) FROM flows WHERE a = b) AS selves,
(SELECT count(*) FROM flows f WHERE NOT EXISTS (SELECT 1 FROM flows g WHERE g.a = f.b AND g.b = f.a)) AS one_way""")
def graph_report(spark, sf_dir):
    e = flows(spark, sf_dir).select("a", "b")
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("back", F.lit(True))
    marked = e.join(back, ["a", "b"], "left").agg(F.count("*").alias("relations"), F.count_if(F.col("a") == F.col("b")).alias("selves"), F.count_if(F.col("back").isNull()).alias("one_way"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("n")).agg(F.count_distinct("n").alias("nodes"))
    return marked.join(F.broadcast(nodes), how="cross")  # both are one row


@query("inventory_gaps", "SELECT o_orderkey AS missing FROM (SELECT unnest(range((SELECT min(c_custkey) FROM customer), (SELECT max(c_custkey) + 1 FROM customer))) AS o_orderkey) WHERE o_orderkey NOT IN (SELECT o_custkey FROM orders)")
def inventory_gaps(spark, sf_dir):
    """The numbers between the first and last customer that no order names. Only the two ends reach the driver."""
    lo, hi = table(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    named = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return spark.range(lo or 0, (hi + 1) if hi is not None else 0).join(named, "id", "left_anti").select(F.col("id").alias("missing"))


@query("impact", """WITH changed AS (SELECT p_partkey FROM part WHERE p_size % 10 = 0), k AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM changed))
SELECT l_suppkey, count(*) AS orders_hit FROM k WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_suppkey""")
def impact(spark, sf_dir):
    """One hop of changes: what hangs on a changed part, once a key, without what was dealt with before."""
    changed = table(spark, sf_dir, "part").filter("p_size % 10 = 0").select(F.col("p_partkey").alias("l_partkey"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    hit = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").join(changed, "l_partkey", "left_semi")
    return hit.select("l_suppkey", "l_orderkey").distinct().join(done, "l_orderkey", "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("orders_hit"))
