"""Replays that depend on all that went before for a key: token buckets and leases. Spark sorts each key's rows; a task holds one batch and one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def replay(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """One output row an input row, each key's rows in order: step(state, row) -> (state, output tuple after the key).

    The rows stream through sorted partitions, so a hot key takes time but no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    now, state = k, start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    names = [part.split()[0] for part in schema.split(",")]
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(requests: DataFrame, quota: int, window_s: float) -> DataFrame:
    """requests (request_id, origin, at in seconds) with served and retry_after: a bucket of `quota` tokens an origin that refills evenly over the window."""
    rate = quota / window_s

    def step(state, row):
        level, last = state
        level = quota if last is None else min(quota, level + (row.at - last) * rate)
        served = level >= 1
        return (level - served, row.at), (row.request_id, row.origin, bool(served), 0.0 if served else (1 - level) / rate)

    return replay(requests, "origin", ["at", "request_id"], "request_id long, origin long, served boolean, retry_after double", lambda: (0.0, None), step)


def leases(claims: DataFrame, ttl_s: float) -> DataFrame:
    """claims (claim_id, resource, holder, at in seconds) with granted and run: a lease is granted if it is free, expired, or the holder's own;
    a grant to another holder, or after expiry, is the next run."""

    def step(state, row):
        holder, until, run = state
        live = until is not None and row.at < until
        if live and holder != row.holder:
            return state, (row.claim_id, row.resource, False, run)
        run = run if live else run + 1
        return (row.holder, row.at + ttl_s, run), (row.claim_id, row.resource, True, run)

    return replay(claims, "resource", ["at", "claim_id"], "claim_id long, resource string, granted boolean, run long", lambda: (None, None, 0), step)
