"""The driver's tables, and the domain tables that the queries derive from them, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of facts on two time axes: each order is the next version of its customer's fact.

    entity_id, version_id, version_no, review_state, valid_kind, valid_from, valid_to, known_from, known_to, verified_on,
    reverify_on, release_no, capability.
    """
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    kind = (
        F.when(F.col("o_orderkey") % 11 == 0, "UNKNOWN").when(F.col("o_orderkey") % 13 == 0, "CONDITIONAL")
        .when(F.col("next_day").isNull(), "OPEN_END").otherwise("CLOSED")
    )
    return (
        o.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", F.lead(day).over(w).alias("next_day"), F.row_number().over(w).alias("version_no"))
        .select(
            F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("version_id"), "version_no",
            F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("CANDIDATE").alias("review_state"),
            kind.alias("valid_kind"), day.alias("valid_from"),
            F.when(kind == "CLOSED", F.greatest(day, F.date_sub("next_day", 1))).alias("valid_to"),
            F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("known_from"),
            F.when(F.col("o_orderkey") % 4 == 0, F.date_add(day, 400)).alias("known_to"),
            F.when(F.col("o_orderkey") % 9 != 0, F.date_add(day, 10)).alias("verified_on"),
            F.when(F.col("o_orderkey") % 9 != 0, F.date_add(day, 40 + (F.col("o_orderkey") % 1500).cast("int"))).alias("reverify_on"),
            F.year(day).alias("release_no"), F.substring("o_orderpriority", 1, 1).alias("capability"),
        )
    )


VERSIONS_SQL = """versions AS (
  SELECT entity_id, version_id, version_no, review_state, valid_kind, valid_from,
         CASE WHEN valid_kind = 'CLOSED' THEN greatest(valid_from, next_day - 1) END AS valid_to,
         valid_from + (version_id % 5)::INT AS known_from,
         CASE WHEN version_id % 4 = 0 THEN valid_from + 400 END AS known_to,
         CASE WHEN version_id % 9 <> 0 THEN valid_from + 10 END AS verified_on,
         CASE WHEN version_id % 9 <> 0 THEN valid_from + 40 + (version_id % 1500)::INT END AS reverify_on,
         year(valid_from)::INT AS release_no, capability
  FROM (SELECT *, CASE WHEN version_id % 11 = 0 THEN 'UNKNOWN' WHEN version_id % 13 = 0 THEN 'CONDITIONAL'
                       WHEN next_day IS NULL THEN 'OPEN_END' ELSE 'CLOSED' END AS valid_kind
        FROM (SELECT o_custkey AS entity_id, o_orderkey AS version_id, o_orderdate::DATE AS valid_from,
                     row_number() OVER w AS version_no, lead(o_orderdate::DATE) OVER w AS next_day,
                     CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'APPROVED' ELSE 'CANDIDATE' END AS review_state,
                     substr(o_orderpriority, 1, 1) AS capability
              FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))))"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release a year of orders: release_no, state, published_on."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("release_no")).distinct()
    return years.select("release_no", F.when(F.col("release_no") % 4 == 3, "REVERTED").otherwise("PUBLISHED").alias("state"), F.make_date(F.col("release_no") + 1, F.lit(1), F.lit(15)).alias("published_on"))


RELEASES_SQL = """releases AS (
  SELECT DISTINCT year(o_orderdate)::INT AS release_no, CASE WHEN year(o_orderdate) % 4 = 3 THEN 'REVERTED' ELSE 'PUBLISHED' END AS state,
         make_date(year(o_orderdate) + 1, 1, 15) AS published_on FROM orders)"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found out on fields of versions: version_id, field, state. Each of the first line items is an evaluation of one field."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    field = F.when(F.col("l_linenumber") == 1, "population").when(F.col("l_linenumber") == 2, "terms").otherwise("amount")
    return li.select(F.col("l_orderkey").alias("version_id"), field.alias("field"), F.when(F.col("l_returnflag") == "R", "NOT_INFORMED").otherwise("INFORMED").alias("state"))


EVALUATIONS_SQL = """evaluations AS (
  SELECT l_orderkey AS version_id, CASE l_linenumber WHEN 1 THEN 'population' WHEN 2 THEN 'terms' ELSE 'amount' END AS field,
         max(CASE WHEN l_returnflag = 'R' THEN 'NOT_INFORMED' ELSE 'INFORMED' END) AS state
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents on versions: large returns. version_id, severity, state."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 48")
    return li.select(
        F.col("l_orderkey").alias("version_id"), F.when(F.col("l_quantity") >= 50, "CRITICAL").when(F.col("l_quantity") >= 49, "HIGH").otherwise("LOW").alias("severity"),
        F.when(F.col("l_linenumber") % 3 == 0, "CLOSED").when(F.col("l_linenumber") % 3 == 1, "OPEN").otherwise("IN_REVIEW").alias("state"),
    )


INCIDENTS_SQL = """incidents AS (
  SELECT l_orderkey AS version_id, CASE WHEN l_quantity >= 50 THEN 'CRITICAL' WHEN l_quantity >= 49 THEN 'HIGH' ELSE 'LOW' END AS severity,
         CASE l_linenumber % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'OPEN' ELSE 'IN_REVIEW' END AS state
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)"""
