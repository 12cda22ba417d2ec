"""Tables written once to the folder that driver and executors share, so that later plans start there and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.streaming.events import shared


def durable(rows: DataFrame) -> DataFrame:
    """Write rows once and read them back."""
    path = f"{shared(rows.sparkSession)}/tables/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `place`, their number from 1 in an order that tells them apart, without sorting them in one task.

    Rows are dealt once into as many ranges as there are shuffle partitions, sorted within them and written; a range begins after the
    rows of all ranges before it, of which one count a range is broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = dealt.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    return found.withColumn("place", F.col("_before") + within).drop("_at", "_range", "_before")
