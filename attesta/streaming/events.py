"""Event streams: windowed counts with late data, an outbox that sends each key once, sessions, and their sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream with the table's own schema; ts becomes an instant, as watermarks need one.

    The path is given as a pattern, since a table may be one file, and a stream reads plain paths as folders only.
    """
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    """event_type, starts, n, total by tumbling windows; events later than `late` behind the newest are left out of closed windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("starts"), "n", "total")


def outbox(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, idle: str, late: str) -> DataFrame:
    """user_id, starts, ends, n: runs of a user's events without a pause of `idle`."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one of this machine; a cluster raises an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='spark-streams-')}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its rows from a table in the cluster's shared folder (spark.checkpoint.dir).

    In complete mode each batch replaces the table, so a batch that is repeated after a failure changes nothing; in append mode the file
    sink's log keeps each batch once.
    """
    spark = stream.sparkSession
    home = f"{shared(spark)}/streams/{uuid.uuid4().hex}"
    out = stream.writeStream.option("checkpointLocation", f"{home}/log").trigger(availableNow=True).outputMode(mode)
    if mode == "complete":
        out = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/rows"))
    else:
        out = out.format("parquet").option("path", f"{home}/rows")
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
