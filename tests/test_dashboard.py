"""Numbers of indicators that no limit changes, from one job each."""

from pyspark.sql import functions as F

from attesta.operators import dashboard as D


def test_limits_cut_what_is_shown_only(spark):
    rows = spark.range(1000).repartition(7).select(F.col("id"), (F.col("id") % 10).alias("k"), F.lit(None).cast("string").alias("none"))
    assert D.measure(D.Indicator("a", rows.filter("k < 5"), (F.desc("k"),)), 2) == (500, ['{"id":104,"k":4,"none":null}', '{"id":114,"k":4,"none":null}'])
    assert D.measure(D.Indicator("a", rows, (F.col("id"),)), 0) == (1000, [])
    assert D.measure(D.Indicator("a", rows.filter("id < 0"), (F.col("id"),)), 3) == (0, [])
    got = D.dashboard([D.Indicator("a", rows, (F.col("id"),), True), D.Indicator("b", rows.filter("k = 77"), (F.col("id"),))], 2).collect()
    assert [(r.indicator, r.n, r.alarming, r.place) for r in got] == [("a", 1000, True, 1), ("a", 1000, True, 2), ("b", 0, False, None)]


def test_one_job_and_one_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    spark.sparkContext.setJobGroup("dashboard-test", "")
    try:
        assert D.measure(D.Indicator("a", rows, (F.desc("id"),)), 1) == (100, ['{"id":99}'])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("dashboard-test")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counted = D.counts({"even": F.col("id") % 2 == 0, "none": F.lit(None).cast("boolean")}, rows)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {r.indicator: r.n for r in counted.collect()} == {"even": 50, "none": 0}
