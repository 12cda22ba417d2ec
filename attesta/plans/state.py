"""State that lasts: sessions of a stream, a run that goes on after a stop, a round of monitoring."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from attesta.operators import cycle as C
from attesta.plans.registry import query
from attesta.sources.store import Store
from attesta.sources.tables import table
from attesta.streaming import events as stream
from attesta.streaming import runs, sessions
from attesta.streaming.events import shared

HOUR = 3_600_000
IDLE, LIFE = 12 * HOUR, 24 * HOUR
#: What each type of event does to a session.
KINDS = {"click": ("CONFIRM", "age"), "view": ("CONFIRM", "income"), "error": ("FORGET", "age"), "signup": ("REFUSE", "income"), "purchase": ("TOUCH", None)}


@query("stream_session_state", f"""WITH RECURSIVE e AS (SELECT user_id, event_type, round(value * 100)::BIGINT::VARCHAR AS value, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - {HOUR} FROM events)),
walk(user_id, i, opened, active) AS (SELECT user_id, i, ms, ms FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, CASE WHEN ms >= least(active + {IDLE}, opened + {LIFE}) THEN ms ELSE opened END, ms FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
x AS (SELECT e.*, opened FROM walk JOIN e USING (user_id, i)),
y AS (SELECT *, event_type = 'error' AND lag(event_type) OVER (PARTITION BY user_id, opened, event_type IN ('click', 'error') ORDER BY i) = 'click' AS forgets FROM x),
s AS (SELECT user_id, opened, least(max(ms) + {IDLE}, opened + {LIFE}) AS ended, CASE WHEN opened + {LIFE} < max(ms) + {IDLE} THEN 'LIFETIME' ELSE 'IDLE' END AS why, count(*)::INT AS n_events,
  count(*) FILTER (WHERE event_type IN ('click', 'view', 'signup') OR forgets)::INT AS version, arg_max(CASE event_type WHEN 'click' THEN value ELSE 'NONE' END, i) FILTER (WHERE event_type IN ('click', 'error')) AS age,
  arg_max(CASE event_type WHEN 'view' THEN value ELSE 'REFUSED' END, i) FILTER (WHERE event_type IN ('view', 'signup')) AS income FROM y GROUP BY user_id, opened)
SELECT user_id::VARCHAR AS session, opened, ended, why, n_events, version, coalesce(age, 'NONE') AS age, coalesce(income, 'NONE') AS income FROM s WHERE ended <= (SELECT epoch_us(max(ts)) // 1000 - {HOUR} FROM events)""")
def stream_session_state(spark, sf_dir):
    """The sessions that ended, by twelve idle hours or a day's age, with the facts they ended with."""
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[i])))[F.col("event_type")]
    rows = stream.read(spark, f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session"), "ts", "event_id", pick(0).alias("kind"), pick(1).alias("key"), F.when(F.col("event_type").isin("click", "view"), F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"), F.lit("declared").alias("origin"),
    )
    with sessions.rocksdb(spark):
        closed = stream.drain(sessions.closed_sessions(rows, "1 hour", IDLE, LIFE), "append")
    facts = F.from_json("facts", "map<string, array<string>>")
    known = lambda key, none: F.when(~F.map_contains_key(facts, key), "NONE").otherwise(F.coalesce(facts[key][0], F.lit(none)))
    ms = lambda c: F.unix_millis(c).alias(c)
    return closed.select("session", ms("opened"), ms("ended"), "why", "n_events", "version", known("age", "NONE").alias("age"), known("income", "REFUSED").alias("income"))


@query("resumable_run", "SELECT url, min(page_id) AS page_id, 1::BIGINT AS times FROM pages GROUP BY url")
def resumable_run(spark, sf_dir):
    """The pages that two runs took, the second from its own start: each address once."""
    home = f"{shared(spark)}/runs/{uuid.uuid4().hex}"
    store, path = Store(spark, f"{home}/store"), f"{sf_dir}/pages.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").select("url", "page_id")
    take = lambda fresh, change: change.append("taken", fresh)
    for i in range(2):
        runs.resume(rows, store, "crawl", ["url"], take, f"{home}/log{i}")
    return store.read("taken").groupBy("url", "page_id").agg(F.count("*").alias("times"))


NOW = dt.datetime(2024, 3, 1)


@query("monitoring_cycle", """WITH d AS (SELECT doc_id, text, doc_id % 11 <> 0 AND doc_id % 5 + 1 <= doc_id % 4 + 1 AS due, doc_id % 17 = 0 AS blocked, doc_id % 13 <> 0 AS known, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'new line' WHEN doc_id % 3 = 1 THEN text ELSE array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) END AS body FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, NOT known OR body <> text AS fresh, known AND doc_id % 3 = 0 AS changed FROM d WHERE due AND NOT blocked)
SELECT 'PLANNED' AS step, (SELECT count(*) FROM d WHERE due) AS n UNION ALL SELECT 'BLOCKED', (SELECT count(*) FROM d WHERE due AND blocked) UNION ALL SELECT 'CAPTURED', count(*) FROM g UNION ALL SELECT 'VERSIONS', count(*) FILTER (WHERE fresh) FROM g
UNION ALL SELECT 'CHANGED', count(*) FILTER (WHERE changed) FROM g UNION ALL SELECT 'EVENTS', count(*) FILTER (WHERE changed) FROM g UNION ALL SELECT 'IMPACTED', count(DISTINCT doc_id % 100) FILTER (WHERE changed) FROM g""")
def monitoring_cycle(spark, sf_dir):
    """One round over the documents as sources, some of which say more, some the same and some the same lines in another order."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), F.col("text").alias("body"))
    k = F.col("source_id")
    store = Store(spark, f"{shared(spark)}/rounds/{uuid.uuid4().hex}")
    change = store.change()
    change.replace("sources", d.select("source_id", F.lit("u").alias("url"), (k % 11 != 0).alias("automatic"), (k % 5 + 1).cast("int").alias("every_days"), (F.lit(NOW) - F.make_interval(days=(k % 4 + 1).cast("int"))).alias("last_ok")))
    change.replace("versions", d.filter(k % 13 != 0).select("source_id", F.lit(1).alias("version_no"), F.sha2("body", 256).alias("digest"), "body"))
    change.replace("citations", d.select((k % 100).alias("act_id"), "source_id"))
    change.replace("reviews", spark.createDataFrame([], "act_id long, because long, state string"))
    change.replace("outbox", spark.createDataFrame([], "key string, source_id long, kind string, at timestamp"))
    change.commit()
    told = F.when(k % 3 == 0, F.concat("body", F.lit("\nnew line"))).when(k % 3 == 1, F.col("body")).otherwise(F.array_join(F.reverse(F.split("body", "\n")), "\n"))
    counts = C.cycle(store, d.select("source_id", F.when(k % 17 == 0, 403).otherwise(200).alias("status"), told.alias("body")), NOW)
    return spark.createDataFrame(list(counts.items()), "step string, n long")
