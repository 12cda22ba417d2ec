"""Sessions as keyed state, resumable runs and rounds of monitoring, with stops in between."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import cycle as C
from attesta.sources.store import Store
from attesta.streaming import runs, sessions

START = dt.datetime(2024, 1, 1, 12)
KINDS = "event_id long, session string, ts timestamp, kind string, key string, value string, origin string"
MINUTE = 60_000


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def loop(events, until):
    """Sessions that ended by `until` (minutes), event by event in order of time."""
    found, open_ = [], {}
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        if e[2] > at(until):
            break
        s = open_.get(e[1])
        ms = int((e[2] - START).total_seconds() * 1000)
        if s and ms >= s.ends(sessions.IDLE, sessions.LIFE):
            found.append((e[1], s))
            s = None
        s = open_[e[1]] = s or sessions.Session(ms)
        s.take(ms, *e[3:])
    found += [(k, s) for k, s in open_.items() if s.ends(sessions.IDLE, sessions.LIFE) <= until * MINUTE]
    return sorted((k, s.opened // MINUTE, s.ends(sessions.IDLE, sessions.LIFE) // MINUTE, s.version, json.dumps(s.facts, sort_keys=True), s.events, s.rejected) for k, s in found)


EVENTS = [
    (1, "a", at(0), "CONFIRM", "edad", "40", "declared"), (2, "a", at(10), "REFUSE", "ingreso", None, None), (3, "a", at(20), "FORGET", "edad", None, None), (4, "a", at(25), "FORGET", "nada", None, None),
    (5, "a", at(55), "CONFIRM", "edad", "41", "inferred"),  # 30 minutes after the last: another session
    *((10 + i, "b", at(20 * i), "TOUCH" if i else "CONFIRM", "x", "1", "declared") for i in range(9)),  # two hours and no more
    (30, "c", at(5), "CONFIRM", "no valid", "1", "declared"), (31, "c", at(6), "CONFIRM", "k", "1", "guessed"), (32, "c", at(7), "REFUSE", "k", "1", None), (33, "c", at(8), "CONTEXT", "intention", "x", None),
    (34, "c", at(9), "CONTEXT", "intention", None, None), (35, "c", at(9), "CONTEXT", "other", "x", None), (36, "c", at(9), None, None, None, None), (40, "z", at(600), "TOUCH", None, None, None), (41, None, at(1), "TOUCH", None, None, None),
]


def test_one_session_by_hand():
    s = sessions.Session(0)
    for e in EVENTS[:4]:
        s.take(int((e[2] - START).total_seconds() * 1000), *e[3:])
    assert (s.facts, s.version, s.events, s.ends(sessions.IDLE, sessions.LIFE)) == ({"ingreso": None}, 3, 4, 55 * MINUTE)
    assert [(k, a, b) for k, a, b, *_ in loop([e for e in EVENTS if e[1]], 540)] == [("a", 0, 55), ("a", 55, 85), ("b", 0, 120), ("b", 120, 190), ("c", 5, 39)]


@pytest.mark.parametrize("files", [[range(len(EVENTS))], [range(1, len(EVENTS), 2), range(0, len(EVENTS), 2)]])
def test_sessions_end_by_idleness_and_age_whatever_the_batches(spark, tmp_path, files):
    """The second form brings events out of order and stops the stream between its files."""
    with sessions.rocksdb(spark):
        for i, picked in enumerate(files):
            # with four hours of patience nothing is late
            rows = [EVENTS[k] for k in picked if EVENTS[k][1] != "z"] + ([e for e in EVENTS if e[1] == "z"] if i == len(files) - 1 else [])
            spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
            stream = spark.readStream.schema(KINDS).parquet(f"{tmp_path}/in/*.parquet")
            out = sessions.closed_sessions(stream, "4 hours").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log")
            out.trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema(sessions.CLOSED).parquet(f"{tmp_path}/out").collect()
    minutes = lambda t: int((t - START).total_seconds() // 60)
    got = sorted((r.session, minutes(r.opened), minutes(r.ended), r.version, r.facts, r.n_events, r.n_rejected) for r in found)
    assert got == loop([e for e in EVENTS if e[1]], 360)
    assert {(r.session, minutes(r.opened)): r.why for r in found} == {("a", 0): "IDLE", ("a", 55): "IDLE", ("b", 0): "LIFETIME", ("b", 120): "IDLE", ("c", 5): "IDLE"}


def test_a_run_goes_on_after_any_stop(spark, tmp_path, monkeypatch):
    kinds = "url string, body string"
    store = Store(spark, f"file://{tmp_path}/s")
    for i, rows in enumerate([[("a", "1"), ("b", "1"), ("a", "1")], [("b", "2"), ("c", "1"), (None, "x")], [(None, "y"), ("d", "1")]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = lambda: spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    work = lambda fresh, change: change.append("pages", fresh.select("url", "body"))
    calls, put = [], Store._put

    def stops(self, version, state):
        """The first batch fails before its commit, the second after it."""
        calls.append(version)
        if len(calls) == 1:
            raise RuntimeError("stopped before the commit")
        put(self, version, state)
        if len(calls) == 3:
            raise RuntimeError("stopped after the commit")

    monkeypatch.setattr(Store, "_put", stops)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            runs.resume(stream(), store, "crawl", ["url"], work, f"{tmp_path}/log")
    runs.resume(stream(), store, "crawl", ["url"], work, f"{tmp_path}/log")
    pages = [(r.url, r.body) for r in store.read("pages").collect()]
    assert sorted(u or "" for u, _ in pages) == ["", "a", "b", "c", "d"] and store.read("batches").count() == 3
    version = store.version()
    runs.resume(stream(), store, "crawl", ["url"], work, f"{tmp_path}/log")
    assert store.version() == version


def test_rounds_of_monitoring(spark, tmp_path):
    now, day = dt.datetime(2024, 3, 1), dt.timedelta(days=1)
    store = Store(spark, f"file://{tmp_path}/s")
    change = store.change()
    old = now - 3 * day
    sources = [(1, "u1", True, 2, old), (2, "u2", True, 30, old), (3, "u3", False, 1, None), (4, None, True, 1, None), (5, "u5", True, 1, None), (6, "u6", True, 1, old), (7, "u7", True, 1, old)]
    change.replace("sources", spark.createDataFrame(sources, "source_id long, url string, automatic boolean, every_days int, last_ok timestamp"))
    versions = [(1, 1, "a\nb\nc"), (6, 1, "x\ny"), (7, 1, "same")]
    change.replace("versions", spark.createDataFrame(versions, "source_id long, version_no int, body string").withColumn("digest", F.sha2("body", 256)).select("source_id", "version_no", "digest", "body"))
    change.replace("citations", spark.createDataFrame([(10, 1), (11, 1), (10, 6), (12, 7)], "act_id long, source_id long"))
    change.replace("reviews", spark.createDataFrame([(11, 9, "OPEN")], "act_id long, because long, state string"))
    change.replace("outbox", spark.createDataFrame([], "key string, source_id long, kind string, at timestamp"))
    change.commit()
    told = [(1, 200, "a\nB\nc"), (2, 200, "not due"), (5, 200, "first"), (6, 200, "y\nx"), (7, 200, "same"), (7, 403, None)]
    captures = spark.createDataFrame(told, "source_id long, status int, body string")
    assert C.cycle(store, captures, now, dry=True)["PLANNED"] == 4 and store.version() == 1
    # 1 changed, 6 only moved its lines, 5 is new, 7 says the same
    assert C.cycle(store, captures, now) == {"PLANNED": 4, "CAPTURED": 4, "VERSIONS": 3, "CHANGED": 1, "IMPACTED": 1, "EVENTS": 1, "BLOCKED": 1}
    assert {(r.act_id, r.because) for r in store.read("reviews").collect()} == {(11, 9), (10, 1)}
    assert {(r.source_id, r.version_no) for r in store.read("versions").collect()} == {(1, 1), (6, 1), (7, 1), (1, 2), (5, 1), (6, 2)}
    assert [r.source_id for r in store.read("sources").filter("not automatic").orderBy("source_id").collect()] == [3, 7]
    assert C.cycle(store, captures, now) == dict.fromkeys(C.STEPS, 0) | {"BLOCKED": 0} and store.version() == 2
    later = C.cycle(store, captures, now + 5 * day)  # the same captures again
    assert (later["PLANNED"], later["VERSIONS"], later["EVENTS"]) == (3, 0, 0)


def test_a_batch_of_a_session_is_one_row_of_its_state():
    class Part:
        def __init__(self):
            self.held, self.calls = [], 0

        def appendList(self, rows):  # noqa: N802
            self.held, self.calls = self.held + list(rows), self.calls + 1

        def put(self, rows):
            self.held = list(rows)

        def get(self):
            return iter(self.held)

        def clear(self):
            self.held = []

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

        def registerTimer(self, at):  # noqa: N802
            self.at = at

    s, times = sessions.Sessions(10, 1000), Times()
    s.handle, s.waiting, s.open = times, Part(), Value()
    event = lambda ms, n, value: ("a", None, ms * 1000, json.dumps({"at_us": ms * 1000, "event_id": n, "kind": "CONFIRM", "key": "k", "value": value, "origin": "declared"}))
    assert list(s.handleInputRows(("a",), iter([event(7, 2, "y"), event(5, 1, "x"), event(40, 3, "é\n")]), times)) == []
    assert (s.waiting.calls, len(s.waiting.held), times.at) == (1, 1, 5)
    times.now = 20
    (row,) = s.handleExpiredTimer(("a",), times, None)
    assert (row.why, row.version, row.n_events, json.loads(row.facts), times.at) == ("IDLE", 2, 2, {"k": ["y", "declared"]}, 40)
    times.now = 45
    assert list(s.handleExpiredTimer(("a",), times, None)) == [] and s.waiting.held == [] and times.at == 50
    times.now = 50
    (row,) = s.handleExpiredTimer(("a",), times, None)
    assert json.loads(row.facts) == {"k": ["é\n", "declared"]} and s.open.held is None
