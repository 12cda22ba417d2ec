"""Streams with rows that come after their window or session was closed."""

from datetime import datetime, timedelta

from attesta.streaming import events as stream

START = datetime(2024, 1, 1, 12)


def write(spark, path, name, rows):
    df = spark.createDataFrame([(i, u, "click", 1.0, START + timedelta(minutes=m)) for i, u, m in rows], "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    df.coalesce(1).write.parquet(f"{path}/{name}.parquet")


def drain_in_order(spark, tmp_path, make, mode):
    """Three batches: a batch drops what is older than the watermark that the batch before it ran under, so the third drops late rows."""
    write(spark, tmp_path, "1", [(1, 7, 0), (2, 7, 10), (3, 8, 5), (4, 9, 300)])
    schema = spark.read.parquet(f"{tmp_path}/1.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    write(spark, tmp_path, "2", [(6, 9, 310)])
    write(spark, tmp_path, "3", [(5, 7, 20), (7, 8, 900)])
    return stream.drain(make(rows.withColumn("ts", rows.ts.cast("timestamp"))), mode).collect()


def test_late_event_joins_no_closed_session(spark, tmp_path):
    got = drain_in_order(spark, tmp_path, lambda e: stream.sessions(e, "30 minutes", "1 hour"), "append")
    at = lambda t: int((t - START).total_seconds() // 60)
    assert sorted((x.user_id, at(x.starts), at(x.ends), x.n) for x in got) == [(7, 0, 40, 2), (8, 5, 35, 1), (9, 300, 340, 2)]


def test_late_event_counts_in_no_closed_window(spark, tmp_path):
    got = drain_in_order(spark, tmp_path, lambda e: stream.window_counts(e, "1 hour", "1 hour"), "append")
    assert sorted(x.n for x in got) == [2, 3]
