"""Publishing over the driver's tables: gates, what waits, releases that inherit, reverting, and the audit of a repeated run."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import publishing as P
from attesta.plans.registry import query
from attesta.sources.store import Store, difference
from attesta.sources.tables import INCIDENTS_SQL, VERSIONS_SQL, incidents, table, versions
from attesta.streaming.events import shared

DAY = dt.datetime(2003, 1, 1)
#: The first release takes the versions up to this number.
FIRST = 4


def sources(spark, sf_dir, faults: bool) -> dict[str, DataFrame]:
    """The tables that publishing reads, derived from orders and line items: an order is a version and its document, a line is a unit with a
    claim and its evidence. With faults, some claims have no evidence, some evidence is of another document, some texts hold markup,
    every other act shares its key and fields are evaluated on some versions only."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("r"))
    at = lambda n: (F.col("p") % n == 0) & F.lit(faults)
    unit, doc = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.col("l_orderkey").alias("doc_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    told = o.filter((F.col("o_orderkey") % 6 != 0) | F.lit(not faults))
    state = F.when(F.col("review_state") == "CANDIDATE", "CANDIDATE").otherwise("APPROVED")
    kind = F.when(F.col("entity_id") % 3 == 0, "ACT").otherwise("PLACE")
    return {
        "versions": versions(spark, sf_dir).select("version_id", kind.alias("entity_type"), "entity_id", "version_no", state.alias("review_state"), "valid_kind", "verified_on", F.lit(None).cast("string").alias("release_id")),
        "claims": li.select(unit.alias("claim_id"), F.col("l_orderkey").alias("version_id"), F.when(F.col("r") == "A", "APPROVED").otherwise("CANDIDATE").alias("review_state"), F.lit("INFORMED").alias("field_state"), F.when(~at(97), unit).alias("evidence_id")),
        "evaluations": told.select(F.col("o_orderkey").alias("version_id"), F.explode(F.array(*(F.lit(f"field {i}") for i in range(7)))).alias("field")),
        "evidence": li.select(unit.alias("evidence_id"), F.when(at(89), F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("doc_id"), unit),
        "units": li.select(unit, doc, F.when(F.col("r") == "R", "QUOTED").otherwise("ENACTING").alias("role"), F.concat(F.lit("part "), F.when(at(83), "<br/>").otherwise(""), F.col("p").cast("string")).alias("text")),
        "version_docs": o.select(F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("doc_id")),
        "acts": o.select(F.col("o_orderkey").alias("act_id"), F.lit(1).alias("jurisdiction"), F.lit("ley").alias("type"), (F.floor(F.col("o_orderkey") / 2) if faults else F.col("o_orderkey")).alias("number"), F.lit(2000).alias("year"), (F.col("o_orderkey") % 8 == 0).alias("uncertain")),
        "incidents": incidents(spark, sf_dir),
    }


STATES_SQL = f"""{VERSIONS_SQL}, {INCIDENTS_SQL}, li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_returnflag) AS r FROM lineitem GROUP BY ALL),
grave AS (SELECT DISTINCT version_id FROM incidents WHERE severity IN ('HIGH', 'CRITICAL') AND state IN ('OPEN', 'IN_REVIEW')),
ready AS (SELECT *, CASE WHEN entity_id % 3 = 0 THEN 'ACT' ELSE 'PLACE' END AS entity_type FROM versions WHERE review_state <> 'CANDIDATE' AND verified_on IS NOT NULL AND valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND version_id NOT IN (SELECT version_id FROM grave)),
first AS (SELECT * FROM ready WHERE version_no <= {FIRST}), second AS (SELECT * FROM ready WHERE version_no > {FIRST}),
members AS (SELECT 1 AS release, version_id, false AS inherited FROM first UNION ALL SELECT 2, version_id, false FROM second
  UNION ALL SELECT 2, version_id, true FROM first WHERE entity_id NOT IN (SELECT entity_id FROM second)),
cited AS (SELECT l_orderkey AS version_id, count(*) AS n FROM li WHERE r <> 'R' GROUP BY l_orderkey)"""


@query("publication_gates", f"""WITH {STATES_SQL}, acts AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 8 <> 0 GROUP BY o_orderkey // 2 HAVING count(*) > 1)
SELECT 'CLAIMS_HAVE_EVIDENCE' AS gate, count(*) FILTER (WHERE r = 'A' AND p % 97 = 0) AS failures FROM li UNION ALL SELECT 'FIELDS_EVALUATED', count(*) FILTER (WHERE o_orderkey % 6 = 0) FROM orders
UNION ALL SELECT 'EVIDENCE_OF_ONE_VERSION', count(*) FILTER (WHERE p % 89 = 0) FROM li UNION ALL SELECT 'RANGE_RESOLVED', count(*) FILTER (WHERE valid_kind IN ('UNKNOWN', 'CONDITIONAL')) FROM versions
UNION ALL SELECT 'NO_GRAVE_INCIDENT', count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL') AND state IN ('OPEN', 'IN_REVIEW')) FROM incidents UNION ALL SELECT 'NO_MARKUP', count(*) FILTER (WHERE p % 83 = 0) FROM li
UNION ALL SELECT 'ONE_ACT_A_KEY', count(*) FROM acts UNION ALL SELECT 'REVIEWED', count(*) FILTER (WHERE review_state = 'CANDIDATE') FROM versions""")
def publication_gates(spark, sf_dir):
    """All eight gates over all versions, as if all were chosen."""
    t = sources(spark, sf_dir, True)
    return P.gates(t, t["versions"])


@query("publication_waiting", f"""WITH {STATES_SQL} SELECT v.version_id, concat_ws(',', CASE WHEN review_state = 'CANDIDATE' THEN 'REVIEW_CANDIDATE' END, CASE WHEN valid_kind IN ('UNKNOWN', 'CONDITIONAL') THEN 'RANGE_' || valid_kind END,
 CASE WHEN verified_on IS NULL THEN 'NOT_VERIFIED' END, CASE WHEN g.version_id IS NOT NULL THEN 'GRAVE_INCIDENT' END) AS reasons FROM versions v LEFT JOIN grave g ON g.version_id = v.version_id WHERE v.version_id NOT IN (SELECT version_id FROM ready)""")
def publication_waiting(spark, sf_dir):
    t = sources(spark, sf_dir, False)
    return P.waiting(t["versions"], t["incidents"]).select("version_id", F.array_join("reasons", ",").alias("reasons"))


def filled(spark, sf_dir) -> Store:
    store = Store(spark, f"{shared(spark)}/releases/{uuid.uuid4().hex}")
    change = store.change()
    for name, rows in sources(spark, sf_dir, False).items():
        change.replace(name, rows)
    change.commit()
    return store


def released(spark, sf_dir) -> tuple[Store, list[str]]:
    """A store with two releases, and their ids."""
    store = filled(spark, sf_dir)
    first = P.publish(store, "editor", "first", DAY, f"version_no <= {FIRST}")
    return store, [first["release_id"], P.publish(store, "editor", "second", DAY + dt.timedelta(days=1))["release_id"]]


@query("publish_release", f"WITH {STATES_SQL} SELECT release::INT AS release, version_id, inherited, coalesce(n, 0) AS fragments FROM members LEFT JOIN cited USING (version_id)")
def publish_release(spark, sf_dir):
    """The members of two releases with their citable fragments: the second inherits the versions of the entities that it has none of."""
    store, ids = released(spark, sf_dir)
    number = F.when(F.col("release_id") == ids[0], 1).otherwise(2)
    told = store.read("fragments").groupBy("release_id", "version_id").agg(F.count("*").alias("fragments"))
    found = store.read("members").join(told, ["release_id", "version_id"], "left")
    return found.select(number.alias("release"), "version_id", "inherited", F.coalesce("fragments", F.lit(0)).alias("fragments"))


@query("revert_release", f"""WITH {STATES_SQL} SELECT CASE WHEN f.version_id IS NOT NULL THEN 'PUBLISHED' WHEN v.review_state = 'CANDIDATE' THEN 'CANDIDATE' ELSE 'APPROVED' END AS review_state,
CASE WHEN f.version_id IS NOT NULL THEN 1 WHEN s.version_id IS NOT NULL THEN 2 END::INT AS release, count(*) AS n FROM versions v LEFT JOIN first f ON f.version_id = v.version_id LEFT JOIN second s ON s.version_id = v.version_id GROUP BY ALL""")
def revert_release(spark, sf_dir):
    """Versions by state and release after the second release is reverted: its own are approved again, the first one's stay published."""
    store, ids = released(spark, sf_dir)
    P.revert(store, ids[1], "editor", "wrong", DAY + dt.timedelta(days=2))
    number = F.when(F.col("release_id") == ids[0], 1).when(F.col("release_id") == ids[1], 2)
    return store.read("versions").groupBy("review_state", number.alias("release")).agg(F.count("*").alias("n"))


@query("idempotence_audit", """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), c AS (SELECT 'acts' AS "table", (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'claims', (SELECT count(*) FROM li) UNION ALL SELECT 'units', (SELECT count(*) FROM li) UNION ALL SELECT 'versions', (SELECT count(*) FROM orders))
SELECT "table", n AS rows_before, n AS rows_after, 0::BIGINT AS added, 0::BIGINT AS gone FROM c""")
def idempotence_audit(spark, sf_dir):
    """What a second load of the same rows does to a store: nothing."""
    keys = {"acts": ["act_id"], "claims": ["claim_id"], "units": ["unit_id"], "versions": ["version_id"]}
    store, t = Store(spark, f"{shared(spark)}/loads/{uuid.uuid4().hex}"), sources(spark, sf_dir, False)
    for _ in range(2):
        change = store.change()
        for name, key in keys.items():
            change.upsert(name, t[name], key)
        change.commit()
    return difference(store, 1, 2)
