"""Runs that can be stopped at any batch and go on: what a batch makes, the keys it has done and its number are one commit of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.store import Change, Store


def once(store: Store, run: str, keys: list[str], work: Callable[[DataFrame, Change], None], source: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch of the stream whose checkpoint is `source`. Of each batch, work gets the rows whose keys no batch of the run has done, each key once, and the change that its
    results go to. The change also takes the keys and the batch's number, so a batch that is repeated after a failure, before or after
    its commit, leaves the same rows. Of several rows of a key, also of equal ones, the first in order of all columns counts; null keys are equal.
    """

    def batch(rows: DataFrame, number: int) -> None:
        change = store.change()
        if "batches" in change.state and not change.read("batches").filter((F.col("run") == run) & (F.col("source") == source) & (F.col("batch") == number)).isEmpty():
            return
        rest = [c for c in rows.columns if c not in keys]
        fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else rows.select(*keys).distinct()
        table = f"done_{run}"
        if table in change.state:
            done = change.read(table).select(*(F.col(k).alias(f"_{k}") for k in keys))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            fresh = fresh.join(done, same, "left_anti")
        change.replace("fresh", fresh)  # written aside, so that work and the keys see the same rows
        fresh = change.read("fresh")
        work(fresh, change)
        change.append(table, fresh.select(*keys))
        change.append("batches", store.spark.createDataFrame([(run, source, number)], "run string, source string, batch long"))
        del change.state["fresh"]
        change.commit()

    return batch


def resume(stream: DataFrame, store: Store, run: str, keys: list[str], work: Callable[[DataFrame, Change], None], checkpoint: str) -> None:
    """Run over all that a stream has now, from where the run's checkpoint is."""
    query = stream.writeStream.foreachBatch(once(store, run, keys, work, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
