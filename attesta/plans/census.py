"""A census out of orders: each year's orders are a sheet that names customers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.sources import census as C
from attesta.sources.store import Store
from attesta.sources.tables import table
from attesta.streaming.events import shared

SHEETS_SQL = """s AS (SELECT CASE WHEN o_orderkey % 19 <> 0 THEN 'R' || o_custkey END AS external_id, 'sheet-' || year(o_orderdate) AS sheet, make_date(year(o_orderdate), 6, 30) AS seen_on, o_orderkey AS place,
  'Barrio ' || o_orderpriority AS name, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::BIGINT END AS families FROM orders),
f AS (SELECT external_id, sheet, seen_on, arg_min(name, place) AS name, first(families ORDER BY place) AS families FROM s WHERE external_id IS NOT NULL GROUP BY external_id, sheet, seen_on)"""


def sheets(spark, sf_dir):
    """The rows of all sheets: an order each, some without an id, several of a customer."""
    year, none = F.year("o_orderdate"), lambda c: F.lit(None).cast("string").alias(c)
    told = F.concat_ws("|", "o_custkey", "o_orderpriority", "o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("sheet-"), year).alias("sheet"), F.make_date(year, F.lit(6), F.lit(30)).alias("seen_on"), F.col("o_orderkey").alias("place"),
        F.when(F.col("o_orderkey") % 19 != 0, F.concat(F.lit("R"), "o_custkey")).alias("external_id"), F.concat(F.lit("Barrio "), "o_orderpriority").alias("name"), none("province"), none("department"), none("town"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("long")).alias("families"), F.lit(None).cast("long").alias("dwellings"), told.alias("fragment"), F.sha2(told, 256).alias("fragment_sha256"),
    )


@query("census_history", f"""WITH {SHEETS_SQL} SELECT external_id, row_number() OVER w AS version_no, sheet, name, families, seen_on::VARCHAR AS known_from, (lead(seen_on) OVER w)::VARCHAR AS known_to FROM f WINDOW w AS (PARTITION BY external_id ORDER BY seen_on)""")
def census_history(spark, sf_dir):
    """All years' sheets at once."""
    return C.history(sheets(spark, sf_dir)).select("external_id", "version_no", "sheet", "name", "families", F.col("known_from").cast("string").alias("known_from"), F.col("known_to").cast("string").alias("known_to"))


LOADED = (1996, 1998, 2000)


@query("census_load", f"""WITH {SHEETS_SQL}, l AS (SELECT * FROM f WHERE year(seen_on) IN {LOADED}) SELECT external_id, row_number() OVER w AS version_no, sheet, name, families, seen_on::VARCHAR AS known_from, (lead(seen_on) OVER w)::VARCHAR AS known_to FROM l WINDOW w AS (PARTITION BY external_id ORDER BY seen_on)""")
def census_load(spark, sf_dir):
    """Three years' sheets brought into a store one after another, the second one twice."""
    store = Store(spark, f"{shared(spark)}/stores/{uuid.uuid4().hex}")
    for year in (LOADED[0], LOADED[1], LOADED[1], LOADED[2]):
        C.load(store, sheets(spark, sf_dir).filter(F.col("sheet") == f"sheet-{year}").drop("sheet", "seen_on"), f"sheet-{year}", dt.date(year, 6, 30))
    return store.read("census").select("external_id", "version_no", "sheet", "name", "families", F.col("known_from").cast("string").alias("known_from"), F.col("known_to").cast("string").alias("known_to"))
