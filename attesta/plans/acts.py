"""Acts that cite each other: citations read from text, relations, what stays pending, and the dates of documents. The texts are written
from the tables; the SQL takes what they must yield from the tables themselves and reads no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import relations as R
from attesta.operators import text as T
from attesta.plans.registry import query
from attesta.sources.tables import table

VERBS = [("REPEALED_BY", r"(?i)derogad[ao] por"), ("AMENDS", r"(?i)modif[ií][cq]\w+")]
PASSIVE = {"REPEALED_BY": "REPEALS"}


def acts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("act_id"), F.expr("o_custkey % 5").alias("jurisdiction"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'ley' ELSE 'decreto' END").alias("type"),
        F.expr("o_orderkey div 3").alias("number"), F.year("o_orderdate").alias("year"), F.expr("o_orderkey % 7 = 0").alias("uncertain"),
    )


def cites(spark, sf_dir):
    """The citations that the units of the acts hold, read from their text."""
    verb = F.expr("CASE l_returnflag WHEN 'A' THEN 'Modifícase la ' WHEN 'R' THEN 'Artículo derogado por ' ELSE 'Visto lo dispuesto en ' END")
    kind = F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'Ley' ELSE 'Decreto' END")
    year = F.expr("CASE l_linenumber % 4 WHEN 1 THEN concat('/', lpad(year(l_shipdate) % 100, 2, '0')) WHEN 3 THEN concat('/', year(l_shipdate)) ELSE '' END")
    number = F.regexp_replace(F.format_number("l_partkey", 0), ",", ".")
    told = F.concat(verb, kind, F.lit(" N° "), number, year, F.lit(" y sus normas."))
    units = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("unit_id"), told.alias("text"))
    read = T.citations(units, "unit_id", "text", "ley|decreto", VERBS)
    placed = read.withColumn("act_id", F.expr("unit_id div 10")).join(acts(spark, sf_dir).select("act_id", "jurisdiction"), "act_id")
    return R.resolved(placed, acts(spark, sf_dir))


CITES_SQL = """acts AS (SELECT o_orderkey AS act_id, o_custkey % 5 AS j, CASE WHEN o_orderkey % 2 = 0 THEN 'ley' ELSE 'decreto' END AS act, o_orderkey // 3 AS number, year(o_orderdate) AS year, o_orderkey % 7 = 0 AS uncertain FROM orders),
told AS (SELECT DISTINCT l_orderkey AS act_id, l_orderkey * 10 + l_linenumber AS unit_id, CASE WHEN l_suppkey % 2 = 0 THEN 'ley' ELSE 'decreto' END AS act, l_partkey AS number, CASE WHEN l_linenumber % 2 = 1 THEN year(l_shipdate) END AS year,
  CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'R' THEN 'REPEALED_BY' ELSE 'CITES' END AS relation FROM lineitem),
cites AS (SELECT t.act_id, t.unit_id, t.act, t.number, t.year, t.relation, count(a.act_id) AS candidates, CASE WHEN count(a.act_id) = 1 THEN min(a.act_id) END AS target
  FROM told t JOIN acts s ON s.act_id = t.act_id LEFT JOIN acts a ON a.j = s.j AND a.act = t.act AND a.number = t.number AND (t.year IS NULL OR a.year = t.year) AND NOT a.uncertain GROUP BY ALL)"""


@query("relations_built", f"""WITH {CITES_SQL} SELECT DISTINCT CASE relation WHEN 'REPEALED_BY' THEN target ELSE act_id END AS from_id, CASE relation WHEN 'REPEALED_BY' THEN act_id ELSE target END AS to_id,
CASE relation WHEN 'REPEALED_BY' THEN 'REPEALS' ELSE relation END AS relation, CASE WHEN relation <> 'REPEALED_BY' THEN unit_id END AS from_unit, CASE WHEN relation = 'REPEALED_BY' THEN unit_id END AS to_unit FROM cites WHERE target <> act_id""")
def relations_built(spark, sf_dir):
    return R.relations(cites(spark, sf_dir), PASSIVE)


@query("relations_pending", f"WITH {CITES_SQL} SELECT DISTINCT act_id, act, number, year, relation, candidates FROM cites WHERE target IS NULL")
def relations_pending(spark, sf_dir):
    return R.pending(cites(spark, sf_dir))


MONTHS = [m for m in T.MONTHS if m != "setiembre"]
TOLD = "concat(day(d), {0}, element_at(array(" + ", ".join(f"'{m}'" for m in MONTHS) + "), month(d)), ' de ', year(d))"


@query("document_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN o_orderdate::DATE::VARCHAR END AS day, CASE o_orderkey % 6 WHEN 3 THEN 'SEVERAL' WHEN 4 THEN 'OTHER_ACTS' WHEN 5 THEN 'LOOSE' ELSE 'GIVEN' END AS state,
CASE WHEN o_orderkey % 6 = 4 THEN 'Decreto ' || o_orderkey || '/' || year(o_orderdate) ELSE '' END AS acts FROM orders""")
def document_dates(spark, sf_dir):
    head = F.concat(F.lit("Buenos Aires, "), F.expr(TOLD.format("' de '")))
    formula = lambda: F.concat(F.lit("Dada a los "), F.expr(TOLD.format("' días del mes de '")))
    n = F.col("o_orderkey") % 6
    note = F.concat(F.lit("Art. 1 (texto sustituido por Decreto N° "), "o_orderkey", F.lit("/"), F.year("d"), F.lit(" (B.O. 3), dado el "), F.date_format("d", "d/M/y"), F.lit("). Rige."))
    text = (
        F.when(n == 0, F.concat(head, F.lit("\nVisto."))).when(n == 1, formula()).when(n == 2, F.concat(head, F.lit(".\n"), formula()))
        .when(n == 3, F.concat(head, F.lit(".\nDada a los 1 días del mes de enero de 1901"))).when(n == 4, note).otherwise(F.concat(F.lit("Visto lo actuado el "), F.date_format("d", "d/M/y")))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    read = o.select("o_orderkey", R.document_date(text).alias("r"))
    return read.select("o_orderkey", F.col("r.date").cast("string").alias("day"), "r.state", F.array_join("r.acts", "; ").alias("acts"))
