"""A round of monitoring over a store: which sources are due, what their captures say, what changed, whom it concerns, and the events of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.rules import unit_diff
from attesta.sources.store import Store

STEPS = ("PLANNED", "CAPTURED", "VERSIONS", "CHANGED", "IMPACTED", "EVENTS")


def due(sources: DataFrame, now: dt.datetime) -> DataFrame:
    """source_id of the sources that may be read by machine, have an address, and were never read well or not within their days."""
    late = F.col("last_ok").isNull() | (F.col("last_ok") + F.make_interval(days=F.col("every_days")) <= F.lit(now))
    return sources.filter(F.col("automatic") & F.col("url").isNotNull() & late).select("source_id")


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each source, by number."""
    return versions.groupBy("source_id").agg(F.max_by(F.struct("version_no", "digest", "body"), "version_no").alias("v")).select("source_id", "v.*")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_id of the sources whose newest body says something else: lines that only moved are no change."""
    lines = lambda d: d.select("source_id", F.posexplode(F.split("body", "\n")).alias("place", "unit"))
    return unit_diff(lines(before), lines(after), ["source_id"]).filter("change not in ('SAME', 'MOVED')").select("source_id").distinct()


def cycle(store: Store, captures: DataFrame, now: dt.datetime, dry: bool = False) -> dict[str, int]:
    """One round, as one commit: how many rows each step of STEPS gave. captures has source_id, status, body.

    Captures of sources that aren't due are left aside; blocked ones (403, 429) pause their source. A body that a source's last version has
    already makes no version. A version that isn't a source's first and says something else is a change; acts that cite its source are
    marked for review, once while the mark is open, and an event is kept under a key of source and digest, so a round that is repeated adds nothing.
    A dry round plans and changes nothing.
    """
    change = store.change()
    sources = change.read("sources")
    planned = due(sources, now)
    counts = dict.fromkeys(STEPS, 0) | {"PLANNED": planned.count(), "BLOCKED": 0}
    if dry or not counts["PLANNED"]:
        return counts
    change.replace("read", captures.join(planned, "source_id", "left_semi").withColumn("digest", F.sha2("body", 256)))
    seen = change.read("read")
    good = seen.filter("status = 200 and body is not null").groupBy("source_id").agg(F.min(F.struct("digest", "body")).alias("c")).select("source_id", "c.*")
    blocked = seen.filter("status in (403, 429)").select("source_id").distinct()
    counts["CAPTURED"], counts["BLOCKED"] = good.count(), blocked.count()
    last = newest(change.read("versions"))
    was = last.select("source_id", F.col("version_no").alias("was_no"), F.col("digest").alias("was"))
    fresh = good.join(was, "source_id", "left").filter(~F.col("was").eqNullSafe(F.col("digest")))
    change.replace("fresh", fresh.select("source_id", (F.coalesce("was_no", F.lit(0)) + 1).cast("int").alias("version_no"), "digest", "body"))
    fresh = change.read("fresh")
    counts["VERSIONS"] = fresh.count()
    again = fresh.filter("version_no > 1")
    change.replace("told", changed(last.join(again, "source_id", "left_semi"), again).join(again.select("source_id", "digest"), "source_id"))
    told = change.read("told")
    counts["CHANGED"] = told.count()
    change.append("versions", fresh)
    hit = change.read("citations").join(told.select("source_id"), "source_id").groupBy("act_id").agg(F.min("source_id").alias("because"))
    counts["IMPACTED"], _ = change.upsert("reviews", hit.select("act_id", "because", F.lit("OPEN").alias("state")), ["act_id"], update=False)
    events = told.select(F.concat_ws(":", F.lit("change"), "source_id", "digest").alias("key"), "source_id", F.lit("SOURCE_CHANGED").alias("kind"), F.lit(now).alias("at"))
    counts["EVENTS"], _ = change.upsert("outbox", events, ["key"], update=False)
    well = sources.join(good.select("source_id"), "source_id", "left_semi").withColumn("last_ok", F.lit(now).cast(sources.schema["last_ok"].dataType))
    change.upsert("sources", well, ["source_id"])
    change.upsert("sources", change.read("sources").join(blocked, "source_id", "left_semi").withColumn("automatic", F.lit(False)), ["source_id"])
    for name in ("read", "fresh", "told"):
        del change.state[name]
    change.commit()
    return counts
