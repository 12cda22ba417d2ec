"""Conversations as keyed state of a stream: facts with their origin, refused or forgotten, until a session ends by idleness or by age."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: how long a session lasts without activity and in all, in milliseconds; what an event can do; where a fact can come from
IDLE, LIFE = 30 * 60_000, 2 * 3_600_000
CONFIRM, REFUSE, FORGET, CONTEXT, TOUCH = "CONFIRM", "REFUSE", "FORGET", "CONTEXT", "TOUCH"
ORIGINS = ("declared", "inferred")
CONTEXT_KEYS = ("intention", "jurisdiction", "date")
EVENT = ("at_us", "event_id", "kind", "key", "value", "origin")
CLOSED = "session string, opened timestamp, ended timestamp, why string, version int, facts string, context string, n_events int, n_rejected int"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session:
    """One session's state. Times are in milliseconds; facts map a key to [value, origin], or to null where the person refused."""

    def __init__(self, opened: int):
        self.opened = self.active = opened
        self.version = self.events = self.rejected = 0
        self.facts: dict[str, list | None] = {}
        self.context: dict[str, str] = {}

    def ends(self, idle: int, life: int) -> int:
        return min(self.active + idle, self.opened + life)

    def take(self, at: int, kind: str, key: str | None, value: str | None, origin: str | None) -> None:
        """One event. What can't be kept is counted and changes nothing: a key that is no name, an unknown origin, a refusal with a value.
        Forgetting what isn't known changes nothing either; a forgotten fact is unknown, not false."""
        self.active = max(self.active, at)
        self.events += 1
        named = bool(key) and key.replace("_", "").isalnum()
        if kind == TOUCH:
            return
        if kind == CONFIRM and named and origin in ORIGINS:
            self.facts[key] = [value, origin]
        elif kind == REFUSE and named and value is None:
            self.facts[key] = None
        elif kind == FORGET and named:
            if key not in self.facts:
                return
            del self.facts[key]
        elif kind == CONTEXT and key in CONTEXT_KEYS:
            if self.context.get(key) == value:
                return
            if value is None:
                del self.context[key]
            else:
                self.context[key] = value
        else:
            self.rejected += 1
            return
        self.version += 1

    def row(self, key: str, idle: int, life: int) -> tuple:
        end = self.ends(idle, life)
        why = "LIFETIME" if end == self.opened + life and end != self.active + idle else "IDLE"
        stamp = lambda ms: EPOCH + dt.timedelta(milliseconds=ms)
        return (key, stamp(self.opened), stamp(end), why, self.version, json.dumps(self.facts, sort_keys=True), json.dumps(self.context, sort_keys=True), self.events, self.rejected)


class Sessions(StatefulProcessor):
    """A key's events wait until the watermark has passed them and are then taken in order of time, so neither batches nor late arrival
    within the watermark change what comes out. A key's events of a batch are one row of its state, and rows don't pass pandas, which costs
    more a key than its events do. A timer fires when the next event or the session's end is due."""

    def __init__(self, idle: int, life: int):
        self.idle, self.life = idle, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")  # the events of each batch as one text
        self.open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found = [r[2:] for r in rows]
        if found:
            self.waiting.appendList([(f"[{','.join([event for _, event in found])}]",)])
            first = min(at for at, _ in found) // 1000
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(map(r.get, EVENT)) for (part,) in self.waiting.get() for r in json.loads(part)]
        due = sorted((r for r in rows if r[0] // 1000 <= now), key=lambda r: tuple((x is not None, x) for x in r))
        later = [r for r in rows if r[0] // 1000 > now]
        if due:
            self.waiting.put([(json.dumps([dict(zip(EVENT, r, strict=True)) for r in later]),)]) if later else self.waiting.clear()
        session, closed = None, []
        before = self.open.get()
        if before is not None:
            session = Session(0)
            session.__dict__.update(json.loads(before[0]))
        for at_us, _, *event in due:
            at = at_us // 1000
            if session and at >= session.ends(self.idle, self.life):
                closed.append(session.row(key[0], self.idle, self.life))
                session = None
            session = session or Session(at)
            session.take(at, *event)
        if session and session.ends(self.idle, self.life) <= now:
            closed.append(session.row(key[0], self.idle, self.life))
            session = None
        wake = [r[0] // 1000 for r in later] + ([session.ends(self.idle, self.life)] if session else [])
        if session:
            self.open.update((json.dumps(session.__dict__),))
        elif before is not None:
            self.open.clear()
        if wake:
            self.handle.registerTimer(max(min(wake), now + 1))
        names = [c.split()[0] for c in CLOSED.split(", ")]
        return iter([Row(**dict(zip(names, x, strict=True))) for x in closed])

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, late: str, idle: int = IDLE, life: int = LIFE) -> DataFrame:
    """The sessions that ended in a stream of events (session, ts, event_id, kind, key, value, origin), each once, with their last state.

    A session begins with an event, and ends `idle` after its last event or `life` after its first one, whichever comes first; an event at
    that time or later begins another. Events are taken in order of ts, then event_id. Sessions that the watermark hasn't passed stay
    open in the state, and nothing else does. Events without a session or time are left out; those older than the watermark are dropped.
    Needs the state store of rocksdb().
    """
    named = events.filter("session is not null and ts is not null").withWatermark("ts", late)
    rows = named.select(F.col("session").cast("string").alias("session"), "ts", F.unix_micros("ts").alias("at_us"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), "kind", "key", "value", "origin")
    rows = rows.select("session", "ts", "at_us", F.to_json(F.struct(*EVENT)).alias("event"))  # fewer columns to turn into objects
    return rows.groupBy("session").transformWithState(Sessions(idle, life), CLOSED, "append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed state with timers needs, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
