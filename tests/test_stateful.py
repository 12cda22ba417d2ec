"""Replays and streams that SQL can't express, against plain loops."""

from attesta.operators import stateful
from attesta.plans import monitoring


def test_rate_limit_against_a_loop(spark, small):
    rows = sorted((r.user_id, r.ts.timestamp(), r.event_id) for r in spark.read.parquet(f"{small}/events.parquet").collect())
    rate, state, want = 3 / 3600.0, {}, {}
    for user, at, i in rows:
        level, last = state.get(user, (3, at))
        level = min(3, level + (at - last) * rate)
        want[i] = level >= 1
        state[user] = (level - want[i], at)
    got = {r.request_id: r.served for r in monitoring.rate_limiter(spark, small).collect()}
    assert got == want


def test_rate_limit_tells_when_to_retry(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0.0, 0.0, 0.0, 30.0, 61.0])], "request_id long, origin long, at double")
    got = [(r.served, round(r.retry_after, 3)) for r in stateful.rate_limit(rows, 2, 60.0).orderBy("request_id").collect()]
    assert got == [(True, 0.0), (True, 0.0), (False, 30.0), (True, 0.0), (True, 0.0)]


def test_leases_fence_other_holders_until_they_expire(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.0), (1, "a", 2, 10.0), (2, "a", 1, 20.0), (3, "a", 2, 49.0), (4, "a", 2, 50.0), (5, "b", 2, 0.0)], "claim_id long, resource string, holder long, at double")
    got = [(r.granted, r.run) for r in stateful.leases(rows, 30.0).orderBy("claim_id").collect()]
    assert got == [(True, 1), (False, 1), (True, 1), (False, 1), (True, 2), (True, 1)]


def test_no_rows_replay_to_none(spark):
    empty = spark.createDataFrame([], "request_id long, origin long, at double")
    assert stateful.rate_limit(empty, 2, 60.0).count() == 0
