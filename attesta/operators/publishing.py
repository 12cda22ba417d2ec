"""Publishing: what may be published, the gates, and releases that inherit what they don't replace, as one change of a store."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.relational import digests
from attesta.operators.temporal import UNRESOLVED, grave_open
from attesta.sources.store import Store

#: The tables that a store of releases has, without those that publishing makes.
SOURCES = ("versions", "claims", "evaluations", "evidence", "units", "version_docs", "acts", "incidents")
#: Fields that each version of an act must have been evaluated on.
FIELDS = 7
# fixed values: the tags that count as markup within a text
TAGS = "p|br|div|span|style|script|details|summary|ul|ol|li|table|tr|td|th|b|i|em|strong|a|h1|h2|h3|h4|h5|h6|blockquote|pre|hr|img"
MARKUP = rf"</?({TAGS})( [^<>]*)?/?>"
RELEASES = "release_id string, state string, published_at timestamp, manifest string, approved_by string, reason string"


class NothingToPublish(Exception):
    """No version may be published: all are, or those that aren't wait for something."""


class Refused(Exception):
    """Gates fail; there is no release."""


def candidates(versions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Versions that are approved, verified, of a resolved range and without an open grave incident."""
    ready = versions.filter((F.col("review_state") == "APPROVED") & F.col("verified_on").isNotNull() & ~F.col("valid_kind").isin(*UNRESOLVED))
    return ready.join(grave_open(incidents), "version_id", "left_anti")


def waiting(versions: DataFrame, incidents: DataFrame) -> DataFrame:
    """version_id, entity_type, reasons of the versions that aren't published and can't be."""
    grave = grave_open(incidents).withColumn("grave", F.lit(True))
    cases = [
        (~F.col("review_state").isin("APPROVED", "PUBLISHED"), F.concat(F.lit("REVIEW_"), F.col("review_state"))), (F.col("valid_kind").isin(*UNRESOLVED), F.concat(F.lit("RANGE_"), F.col("valid_kind"))),
        (F.col("verified_on").isNull(), F.lit("NOT_VERIFIED")), (F.col("grave"), F.lit("GRAVE_INCIDENT")),
    ]
    told = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in cases)), lambda r: r.isNotNull())
    found = versions.filter("review_state <> 'PUBLISHED'").join(grave, "version_id", "left").select("version_id", "entity_type", told.alias("reasons"))
    return found.filter(F.size("reasons") > 0)


def gates(tables: dict[str, DataFrame], chosen: DataFrame) -> DataFrame:
    """gate, failures: eight controls, five on the chosen versions (version_id, valid_kind, review_state) and their claims and units, two on
    all evidence and acts. Each is one sum; all must be 0."""
    ids = chosen.select("version_id")
    mine = lambda t: tables[t].join(ids, "version_id", "left_semi")
    docs = mine("version_docs").select("version_id", "doc_id")
    told = mine("evaluations").groupBy("version_id").agg(F.count_distinct("field").alias("n"))
    units = tables["units"]
    of = units.select("unit_id", F.col("doc_id").alias("unit_doc"))
    key = ("jurisdiction", "type", "number", "year")
    keyed = tables["acts"].filter("not uncertain and number is not null and year is not null").groupBy(*key).agg(F.count("*").alias("n"))
    sums = {
        "CLAIMS_HAVE_EVIDENCE": mine("claims").agg(F.count_if(F.col("review_state").isin("APPROVED", "PUBLISHED") & (F.col("field_state") == "INFORMED") & F.col("evidence_id").isNull())),
        "FIELDS_EVALUATED": docs.select("version_id").distinct().join(told, "version_id", "left").agg(F.count_if(F.coalesce("n", F.lit(0)) < FIELDS)),
        "EVIDENCE_OF_ONE_VERSION": tables["evidence"].join(of, "unit_id").agg(F.count_if(F.col("unit_doc") != F.col("doc_id"))),
        "RANGE_RESOLVED": chosen.agg(F.count_if(F.col("valid_kind").isin(*UNRESOLVED))),
        "NO_GRAVE_INCIDENT": mine("incidents").agg(F.count_if(F.col("state").isin("OPEN", "IN_REVIEW") & F.col("severity").isin("HIGH", "CRITICAL"))),
        "NO_MARKUP": units.join(docs, "doc_id").agg(F.count_if(F.col("text").rlike(MARKUP))),
        "ONE_ACT_A_KEY": keyed.agg(F.count_if(F.col("n") > 1)),
        "REVIEWED": chosen.agg(F.count_if(~F.col("review_state").isin("APPROVED", "PUBLISHED"))),
    }
    rows = [s.toDF("failures").select(F.lit(name).alias("gate"), F.coalesce("failures", F.lit(0)).alias("failures")) for name, s in sums.items()]
    return reduce(DataFrame.unionAll, rows)


def inherited(members: DataFrame, versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The versions of the release before (members) that are still published and whose entity no chosen version replaces."""
    entity = ["entity_type", "entity_id"]
    live = members.select("version_id").join(versions.filter("review_state = 'PUBLISHED'").select("version_id", *entity), "version_id")
    return live.join(chosen.select(*entity).distinct(), entity, "left_anti").select("version_id")


def stopped(before: DataFrame, after: DataFrame, versions: DataFrame) -> DataFrame:
    """entity_type, n: versions that the release before served and the new one doesn't, nor another version of their entity."""
    entity = ["entity_type", "entity_id"]
    of = versions.select("version_id", *entity)
    gone = before.select("version_id").join(after.select("version_id"), "version_id", "left_anti").join(of, "version_id")
    still = after.select("version_id").join(of, "version_id").select(*entity).distinct()
    return gone.join(still, entity, "left_anti").groupBy("entity_type").agg(F.count("*").alias("n"))


def fragments(units: DataFrame, docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """unit_id, version_id, text, digest of what may be cited of the chosen versions: enacting units with text."""
    own = docs.join(chosen.select("version_id"), "version_id", "left_semi").select("version_id", "doc_id")
    told = units.filter("role = 'ENACTING' and trim(text) <> ''").join(own, "doc_id")
    return told.select("unit_id", "version_id", "text", F.sha2("text", 256).alias("digest")).dropDuplicates(["unit_id", "digest"])


def publish(store: Store, actor: str, reason: str, now: dt.datetime, only: str | None = None) -> dict:
    """A new release of all candidates (those that meet `only`), with what it inherits, as one commit: releases, members, versions, claims,
    fragments, controls, outbox and audit change together or not at all. Another writer in between raises Conflict.

    The release's id comes from the store's version and its manifest, so a run that failed and is repeated makes the same one. Returns
    the id, counts, the gates and what stopped being served. Raises NothingToPublish or Refused; then nothing changed.
    """
    change = store.change()
    t = {name: change.read(name) for name in SOURCES}
    chosen = candidates(t["versions"], t["incidents"])
    chosen = chosen.filter(only) if only else chosen
    # the candidates are written aside once, so that all that follows sees the same ones
    change.replace("chosen", chosen.select("version_id", "entity_type", "entity_id", "valid_kind", "review_state"))
    chosen = change.read("chosen")
    n = chosen.count()
    if not n:
        raise NothingToPublish(f"{waiting(t['versions'], t['incidents']).count()} versions wait")
    found = {r["gate"]: r["failures"] for r in gates(t, chosen).collect()}
    if any(found.values()):
        raise Refused(", ".join(f"{g}: {k}" for g, k in found.items() if k))

    spark = store.spark
    served = t["versions"].filter("review_state = 'PUBLISHED'")
    if "releases" in change.state:
        served = served.join(F.broadcast(change.read("releases").filter("state = 'PUBLISHED'")), "release_id", "left_semi")  # a row a release
    whole = chosen.select("version_id").union(served.select("version_id")).distinct().withColumn("k", F.lit("k"))
    manifest = digests(whole, "k", "version_id").first()["digest"]
    release_id = hashlib.sha256(f"{change.base}:{manifest}".encode()).hexdigest()[:32]
    before = None
    if "releases" in change.state:
        last = change.read("releases").filter("state = 'PUBLISHED'").orderBy(F.desc("published_at"), "release_id").first()
        before = last and last["release_id"]

    own = chosen.select(F.lit(release_id).alias("release_id"), "version_id", F.lit(False).alias("inherited"))
    told = fragments(t["units"], t["version_docs"], chosen).withColumn("release_id", F.lit(release_id))
    gone: dict[str, int] = {}
    n_inherited = 0
    if before:
        members = change.read("members").filter(F.col("release_id") == before)
        more = inherited(members, t["versions"], chosen)
        own = own.unionByName(more.select(F.lit(release_id).alias("release_id"), "version_id", F.lit(True).alias("inherited")))
        old = change.read("fragments").filter(F.col("release_id") == before).join(more, "version_id", "left_semi").withColumn("release_id", F.lit(release_id))
        told = told.unionByName(old).dropDuplicates(["unit_id", "digest"])
    change.append("members", own)
    now_served = change.read("members").filter(F.col("release_id") == release_id)
    if before:
        n_inherited = now_served.filter("inherited").count()
        gone = {r["entity_type"]: r["n"] for r in stopped(members, now_served, t["versions"]).collect()}
    change.append("fragments", told.select("release_id", "unit_id", "version_id", "text", "digest"))
    marked = t["versions"].join(chosen.select("version_id"), "version_id", "left_semi").withColumn("review_state", F.lit("PUBLISHED")).withColumn("release_id", F.lit(release_id))
    change.upsert("versions", marked, ["version_id"])
    claims = t["claims"].filter("review_state = 'APPROVED'").join(chosen.select("version_id"), "version_id", "left_semi")
    change.upsert("claims", claims.withColumn("review_state", F.lit("PUBLISHED")), ["claim_id"])
    change.append("releases", spark.createDataFrame([(release_id, "PUBLISHED", now, manifest, actor, reason)], RELEASES))
    passed = spark.createDataFrame(list(found.items()), "control string, failures long")
    change.append("controls", chosen.select(F.lit(release_id).alias("release_id"), "version_id").crossJoin(F.broadcast(passed)))  # eight controls of each version
    payload = json.dumps({"release_id": release_id, "manifest": manifest, "versions": n})
    change.append("outbox", spark.createDataFrame([(f"release:{release_id}", "RELEASE_PUBLISHED", payload, 0, None)], "key string, kind string, payload string, attempts int, delivered_at timestamp"))
    change.append("audit", spark.createDataFrame([(actor, "PUBLISH", release_id, manifest, reason, now)], "actor string, action string, object_id string, after string, reason string, at timestamp"))
    del change.state["chosen"]
    change.commit()
    return {"release_id": release_id, "published": n, "inherited": n_inherited, "stopped": gone, "gates": found}


def revert(store: Store, release_id: str, actor: str, reason: str, now: dt.datetime) -> int:
    """A release isn't served any more; nothing is deleted. Its own versions are approved again, inherited ones stay as they are. One commit;
    how many versions changed."""
    change = store.change()
    own = change.read("versions").filter((F.col("release_id") == release_id) & (F.col("review_state") == "PUBLISHED"))
    _, n = change.upsert("versions", own.withColumn("review_state", F.lit("APPROVED")), ["version_id"])
    release = change.read("releases").filter(F.col("release_id") == release_id)
    change.upsert("releases", release.withColumn("state", F.lit("REVERTED")).withColumn("reason", F.lit(reason)), ["release_id"])
    change.append("audit", store.spark.createDataFrame([(actor, "REVERT", release_id, None, reason, now)], "actor string, action string, object_id string, after string, reason string, at timestamp"))
    change.commit()
    return n
