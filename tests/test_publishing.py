"""A store's commits, and releases in it, on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import publishing as P
from attesta.sources.store import Conflict, Store, difference

NOW = dt.datetime(2024, 5, 1)
VERSION = "version_id long, entity_type string, entity_id long, review_state string, valid_kind string, verified_on date, release_id string"
DAY = dt.date(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_adds_replaces_and_touches_only_what_it_must(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    kinds = "k int, b string, v int"
    change = store.change()
    change.replace("t", spark.createDataFrame([(i, "x", i) for i in range(100)] + [(None, "n", 0)], kinds).repartitionByRange(4, "k"))
    change.commit()
    first = store.state()["t"]["files"]
    change = store.change()
    assert change.upsert("t", spark.createDataFrame([(5, "y", 1), (5, "y", 2), (200, "z", 1), (200, "z", 1), (None, "m", 1), (7, "x", 7)], kinds), ["k"]) == (1, 2)
    assert change.upsert("t", spark.createDataFrame([(6, "no", 1), (201, "yes", 1)], kinds), ["k"], update=False) == (1, 0)
    assert change.upsert("t", spark.createDataFrame([(8, "only", 1), (9, "only", 1)], kinds), ["k"], only="v > 8") == (0, 1)
    assert store.read("t").count() == 101  # nothing counts before the commit
    change.commit()
    found = {r.k: (r.b, r.v) for r in store.read("t").collect()}
    assert len(found) == 103 and store.read("t").count() == 103
    assert [found[k] for k in (5, 6, 7, 8, 9, 200, 201, None)] == [("y", 1), ("x", 6), ("x", 7), ("x", 8), ("only", 1), ("z", 1), ("yes", 1), ("m", 1)]
    assert 1 <= len(set(first) & set(store.state()["t"]["files"])) < len(first)
    assert store.read("t", 1).count() == 101  # older states stay readable
    change = store.change()
    files = change.state["t"]["files"]
    assert change.upsert("t", store.read("t"), ["k"]) == (0, 0) and change.state["t"]["files"] == files
    assert rows(difference(store, 1, 2)) == [("t", 101, 103, 5, 3)]


def test_of_two_writers_one_loses_and_a_killed_one_leaves_no_trace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = store.change()
    one.replace("t", spark.range(3))
    one.commit()
    killed, a, b = store.change(), store.change(), store.change()
    killed.append("t", spark.range(100))  # its files are there, but no commit names them
    a.append("t", spark.range(1))
    b.append("t", spark.range(2))
    assert b.commit() == 2
    with pytest.raises(Conflict):
        a.commit()
    assert store.version() == 2 and store.read("t").count() == 5
    again = store.change()
    again.append("t", spark.range(1))
    assert again.commit() == 3 and store.read("t").count() == 6


def filled(spark, path, **more):
    """A store with versions 1 to 6: 1-3 ready, 4 unverified, 5 of an unknown range, 6 with a grave incident."""
    store = Store(spark, f"file://{path}/s")
    versions = [(1, "ACT", 10, "APPROVED", "CLOSED", DAY, None), (2, "ACT", 20, "APPROVED", "OPEN_END", DAY, None), (3, "PLACE", 10, "APPROVED", "CLOSED", DAY, None)]
    versions += [(4, "ACT", 40, "APPROVED", "CLOSED", None, None), (5, "ACT", 50, "CANDIDATE", "UNKNOWN", DAY, None), (6, "ACT", 60, "APPROVED", "CLOSED", DAY, None)]
    tables = {
        "versions": (versions, VERSION),
        "claims": ([(1, 1, "APPROVED", "INFORMED", 100), (2, 1, "CANDIDATE", "INFORMED", None), (3, 4, "APPROVED", "INFORMED", 100)], "claim_id long, version_id long, review_state string, field_state string, evidence_id long"),
        "evaluations": ([(v, f"f{i}") for v in (1, 2) for i in range(7)], "version_id long, field string"),
        "evidence": ([(100, 1, 1000)], "evidence_id long, doc_id long, unit_id long"),
        "units": ([(1000, 1, "ENACTING", "uno"), (1001, 1, "QUOTED", "dos"), (1002, 2, "ENACTING", " "), (1003, 2, "ENACTING", "tres")], "unit_id long, doc_id long, role string, text string"),
        "version_docs": ([(1, 1), (2, 2)], "version_id long, doc_id long"),
        "acts": ([(1, 1, "ley", 5, 2000, False), (2, 1, "ley", 5, 2000, True)], "act_id long, jurisdiction long, type string, number long, year int, uncertain boolean"),
        "incidents": ([(6, "HIGH", "OPEN"), (1, "CRITICAL", "CLOSED")], "version_id long, severity string, state string"),
    }
    change = store.change()
    for name, (data, kinds) in tables.items():
        change.replace(name, spark.createDataFrame(data + more.get(name, []), kinds))
    change.commit()
    return store


def test_publish_inherit_replace_and_revert(spark, tmp_path):
    store = filled(spark, tmp_path)
    first = P.publish(store, "ana", "first", NOW, "version_id <> 2")
    assert (first["published"], first["inherited"], first["stopped"]) == (2, 0, {}) and set(first["gates"].values()) == {0} and len(first["gates"]) == 8
    assert {(r.version_id, r.review_state) for r in store.read("claims").collect()} == {(1, "PUBLISHED"), (1, "CANDIDATE"), (4, "APPROVED")}
    assert rows(store.read("fragments").select("unit_id", "version_id")) == [(1000, 1)]
    change = store.change()  # a new version of act 10 replaces version 1
    change.append("versions", spark.createDataFrame([(7, "ACT", 10, "APPROVED", "CLOSED", DAY, None)], VERSION))
    change.append("version_docs", spark.createDataFrame([(7, 1)], "version_id long, doc_id long"))
    change.append("evaluations", spark.createDataFrame([(7, f"f{i}") for i in range(7)], "version_id long, field string"))
    change.commit()
    base = store.version()
    second = P.publish(store, "ana", "second", NOW + dt.timedelta(days=1))
    assert (second["published"], second["inherited"], second["stopped"]) == (2, 1, {}) and store.version() == base + 1
    members = store.read("members").filter(F.col("release_id") == second["release_id"])
    assert rows(members.select("version_id", "inherited")) == [(2, False), (3, True), (7, False)]
    assert rows(store.read("fragments").filter(F.col("release_id") == second["release_id"]).select("unit_id", "version_id")) == [(1000, 7), (1003, 2)]
    with pytest.raises(P.NothingToPublish, match="3 versions"):
        P.publish(store, "ana", "again", NOW)
    assert store.version() == base + 1 and store.read("outbox").count() == 2 and store.read("audit").count() == 2 and store.read("controls").count() == 32
    assert P.revert(store, second["release_id"], "ana", "wrong", NOW) == 2
    state = {r.version_id: (r.review_state, r.release_id) for r in store.read("versions").collect()}
    assert state[7] == ("APPROVED", second["release_id"]) and state[3] == ("PUBLISHED", first["release_id"]) and state[1][0] == "PUBLISHED"
    assert rows(store.read("releases").select("state")) == [("PUBLISHED",), ("REVERTED",)]
    third = P.publish(store, "ana", "third", NOW + dt.timedelta(days=2))  # inherits from the first, as the second is reverted
    assert third["published"] == 2 and third["inherited"] == 1 and third["release_id"] != second["release_id"]


@pytest.mark.parametrize(
    ("gate", "more"),
    [
        ("CLAIMS_HAVE_EVIDENCE", {"claims": [(9, 2, "APPROVED", "INFORMED", None)]}), ("FIELDS_EVALUATED", {"version_docs": [(3, 3)]}), ("EVIDENCE_OF_ONE_VERSION", {"evidence": [(101, 2, 1000)]}),
        ("NO_MARKUP", {"units": [(1009, 2, "QUOTED", 'a <br/> b')]}), ("ONE_ACT_A_KEY", {"acts": [(9, 1, "ley", 5, 2000, False)]}),
    ],
)
def test_a_gate_that_fails_leaves_everything_as_it_was(spark, tmp_path, gate, more):
    store = filled(spark, tmp_path, **more)
    with pytest.raises(P.Refused, match=f"^{gate}: 1$"):
        P.publish(store, "ana", "no", NOW)
    assert store.version() == 1 and "releases" not in store.state()


def test_gates_on_what_is_chosen(spark, tmp_path):
    store = filled(spark, tmp_path)
    t = {n: store.read(n) for n in P.SOURCES}
    found = {r.gate: r.failures for r in P.gates(t, t["versions"]).collect()}
    assert (found["RANGE_RESOLVED"], found["NO_GRAVE_INCIDENT"], found["REVIEWED"]) == (1, 1, 1)
    assert {r.version_id: r.reasons for r in P.waiting(t["versions"], t["incidents"]).collect()} == {4: ["NOT_VERIFIED"], 5: ["REVIEW_CANDIDATE", "RANGE_UNKNOWN"], 6: ["GRAVE_INCIDENT"]}


def test_publishing_again_after_a_lost_commit_makes_the_same_release(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path)

    def lost(*_):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lost)
        with pytest.raises(RuntimeError):
            P.publish(store, "ana", "first", NOW)
    assert store.version() == 1 and "members" not in store.state()
    assert P.publish(store, "ana", "first", NOW)["published"] == 3 and store.read("members").count() == 3


def test_tables_of_a_store_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    change = store.change()
    change.replace("a", spark.range(1000).select("id"))
    change.replace("b", spark.range(500).select("id"))
    both = change.read("a").join(change.read("b").select("id"), "id", "left_semi")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 500


def test_an_upsert_writes_rows_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/once")
    rows = spark.createDataFrame([(1, None, "a"), (None, 2, "b"), (None, None, "c"), (None, None, "d")], "k long, l long, v string")
    staged = lambda: len(list((tmp_path / "once/files").iterdir()))
    change = store.change()
    assert change.upsert("t", rows, ["k", "l"]) == (3, 0) and staged() == 2  # an empty table, and its rows
    assert change.upsert("t", rows, ["k", "l"]) == (0, 0) and staged() == 3  # nothing but what differs
    assert change.upsert("t", rows.withColumn("v", F.lit("z")), ["k", "l"], only="v <> 'a'") == (0, 2)
    assert sorted(r["v"] for r in change.read("t").collect()) == ["a", "z", "z"]
