"""Fields found in units that line items write out, their states by version, and the acts that citations would bring in."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import expansion as E
from attesta.operators import fields as C
from attesta.operators import relations as R
from attesta.plans.acts import CITES_SQL, PASSIVE, cites
from attesta.plans.registry import query
from attesta.sources.tables import table

#: What a unit says, and the signals that it must yield, by field.
TOLD = [
    ("Destinadas  A familias; los BENEFICIARIOS cobran.", {"population": "Destinadas  A"}),
    ("Los beneficiarios percibirán, salvo renuncia, una suma de dinero.", {"population": "beneficiarios", "granted": "suma de dinero", "keep": "salvo"}),
    ("Deberán acreditar domicilio los menores de 18 años.", {"access": "Deberán acreditar"}),
    ("Son mayores de 65 años y rige hasta el 31/12 del año.", {"access": "mayores de 65 años", "terms": "hasta el 31/12"}),
    ("Dentro de los quince días se suspenderá todo pago.", {"terms": "Dentro de los quince días", "revocation": "se suspenderá"}),
    ("Caducará el derecho, sin perjuicio de otros.", {"terms": "Caducará el", "revocation": "Caducará", "keep": "sin perjuicio de"}),
    ("Habrá pérdida del derecho a la prestación mensual.", {"revocation": "pérdida del derecho", "granted": "prestación mensual"}),
    ("Nada dispone; insalvo, entitulares de y comúnmente.", {}),
]
UNITS_SQL = """u AS (SELECT l_orderkey AS version_id, l_orderkey * 10 + l_linenumber AS unit_id, min(l_partkey) % 8 AS t, min(l_suppkey) AS s, min(l_partkey) % 3 <> 2 AS enacts FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
SIGNALS_SQL = "(VALUES " + ", ".join(f"({i}, '{text}', '{field}', '{signal}')" for i, (text, found) in enumerate(TOLD) for field, signal in found.items()) + ") k(t, told, field, signal)"
CANDIDATES_SQL = f"""{UNITS_SQL}, x AS (SELECT version_id, unit_id, field, signal, repeat('ñu ', s % 40) || told || repeat(' fin', s % 80) AS text, 3 * (s % 40) + strpos(told, signal) - 1 AS start FROM u JOIN {SIGNALS_SQL} ON k.t = u.t WHERE enacts)"""


def units(spark, sf_dir):
    """version_id, unit_id, role, text: a unit for each line item's number, with words before and after what it says."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    told = F.get(F.array(*(F.lit(t) for t, _ in TOLD)), F.col("p") % len(TOLD))
    text = F.concat(F.repeat(F.lit("ñu "), F.col("s") % 40), told, F.repeat(F.lit(" fin"), F.col("s") % 80))
    return li.select(F.col("l_orderkey").alias("version_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("unit_id"), F.when(F.col("p") % 3 == 2, "QUOTED").otherwise("ENACTING").alias("role"), text.alias("text"))


@query("field_candidates", f"""WITH {CANDIDATES_SQL} SELECT version_id, unit_id, field, signal, start::INT AS start,
sha256(trim(substr(text, greatest(start - {C.BEFORE}, 0)::INT + 1, (start + length(signal) + {C.AFTER} - greatest(start - {C.BEFORE}, 0))::INT))) AS fragment_sha256 FROM x""")
def field_candidates(spark, sf_dir):
    """The first signal of each field in each unit that enacts."""
    return C.candidates(units(spark, sf_dir)).drop("fragment")


def claims(spark, sf_dir):
    """All claims on fields: candidates, which line items of some orders approve, and one on relations for each act that has any."""
    found = C.candidates(units(spark, sf_dir)).select("version_id", "field", F.when(F.col("unit_id") % 7 == 0, "APPROVED").when(F.col("unit_id") % 7 == 1, "REJECTED").otherwise("CANDIDATE").alias("review"))
    linked = C.interdependencies(R.relations(cites(spark, sf_dir), PASSIVE)).select("version_id", F.lit(C.RELATED).alias("field"), F.lit("CANDIDATE").alias("review"))
    return found.unionByName(linked).withColumn("informed", F.lit(True))


FIELDS_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in C.FIELDS) + ") f(field)"
STATES_SQL = f"""{CITES_SQL}, {CANDIDATES_SQL}, r AS (SELECT DISTINCT CASE relation WHEN 'REPEALED_BY' THEN target ELSE act_id END AS a, CASE relation WHEN 'REPEALED_BY' THEN act_id ELSE target END AS b FROM cites WHERE target <> act_id),
claims AS (SELECT version_id, field, CASE unit_id % 7 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'CANDIDATE' END AS review FROM x UNION ALL SELECT DISTINCT v, '{C.RELATED}', 'CANDIDATE' FROM (SELECT a AS v FROM r UNION ALL SELECT b FROM r) y),
g AS (SELECT version_id, field, count(*) FILTER (WHERE review = 'APPROVED') AS a, count(*) FILTER (WHERE review = 'CANDIDATE') AS c FROM claims GROUP BY ALL),
states AS (SELECT o_orderkey AS version_id, f.field, CASE WHEN a > 0 THEN 'INFORMED' WHEN c > 0 THEN 'PENDING' ELSE 'NOT_INFORMED' END AS state, CASE WHEN a > 0 THEN a ELSE coalesce(c, 0) END AS n
  FROM orders CROSS JOIN {FIELDS_SQL} LEFT JOIN g ON g.version_id = o_orderkey AND g.field = f.field)"""


@query("field_states", f"WITH {STATES_SQL} SELECT version_id, field, state, n FROM states")
def field_states(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"))
    return C.states(versions, claims(spark, sf_dir))


@query("field_completeness", f"WITH {STATES_SQL} SELECT field, count(*) AS evaluated, count(*) FILTER (WHERE state = 'INFORMED') AS informed, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'NOT_INFORMED') AS not_informed, count(*) FILTER (WHERE state = 'INFORMED') / count(*) AS informed_share FROM states GROUP BY field")
def field_completeness(spark, sf_dir):
    return C.completeness(field_states(spark, sf_dir))


def catalogue(spark, sf_dir):
    """The acts that parts stand for, with up to two addresses each; some share an identity."""
    p = F.col("p_partkey")
    url = F.element_at(F.array(F.lit("texact.htm"), F.lit("norma.htm"), F.lit("ficha")), (F.pmod(F.col("p_size") + F.col("k"), F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("k = 0 or p_size % 2 = 0").select(
        p.alias("norm_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'ley' ELSE 'decreto' END").alias("act"), F.expr("p_partkey - CASE WHEN p_partkey % 9 = 4 THEN 2 ELSE 0 END").alias("number"),
        (1995 + p % 8).cast("int").alias("year"), (p % 10 == 3).alias("uncertain"), F.concat(F.lit("http://h/"), p.cast("string"), F.lit("/"), url).alias("url"),
    )


EXPANSION_SQL = """sought AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'ley' ELSE 'decreto' END AS act, l_partkey AS number, CASE WHEN l_linenumber % 3 > 0 THEN (1995 + (l_partkey + l_suppkey % 2 * (l_linenumber % 2)) % 8)::INT END AS year, count(*) AS cites FROM lineitem GROUP BY 1, 2, 3),
cat AS (SELECT p_partkey AS norm_id, CASE WHEN p_partkey % 2 = 0 THEN 'ley' ELSE 'decreto' END AS act, p_partkey - CASE WHEN p_partkey % 9 = 4 THEN 2 ELSE 0 END AS number, (1995 + p_partkey % 8)::INT AS year, p_partkey % 10 = 3 AS uncertain,
  'http://h/' || p_partkey || '/' || ['texact.htm', 'norma.htm', 'ficha'][(p_size + k) % 3 + 1] AS url FROM part, (VALUES (0), (1)) t(k) WHERE k = 0 OR p_size % 2 = 0),
per AS (SELECT act, number, year, count(DISTINCT norm_id) AS n, min(norm_id) AS one, bool_or(uncertain) AS uncertain, coalesce(min(url) FILTER (WHERE url LIKE '%texact.htm'), min(url) FILTER (WHERE url LIKE '%norma.htm')) AS url FROM cat GROUP BY ALL)"""


@query("corpus_expansion", f"""WITH {EXPANSION_SQL}, j AS (SELECT s.*, CASE WHEN s.year IS NULL THEN 'NO_YEAR' WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN uncertain THEN 'UNCERTAIN' WHEN url IS NULL THEN 'NO_TEXT' WHEN one % 5 = 0 THEN 'PRESENT' ELSE 'ADD' END AS outcome,
  CASE WHEN n = 1 THEN one END AS norm_id, replace(url, 'http:', 'https:') AS u FROM sought s LEFT JOIN per USING (act, number, year))
SELECT act, number, year, cites, outcome, norm_id, CASE WHEN outcome IN ('PRESENT', 'ADD') THEN u END AS url, CASE WHEN outcome IN ('PRESENT', 'ADD') THEN regexp_extract(u, '[^/]*$') END AS form FROM j""")
def corpus_expansion(spark, sf_dir):
    """What line items cite, without a year for a third, against the parts' acts, of which the corpus has a fifth."""
    cited = table(spark, sf_dir, "lineitem").select(
        F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'ley' ELSE 'decreto' END").alias("act"), F.col("l_partkey").alias("number"),
        F.expr("CASE WHEN l_linenumber % 3 > 0 THEN cast(1995 + (l_partkey + l_suppkey % 2 * (l_linenumber % 2)) % 8 as int) END").alias("year"),
    )
    acts = catalogue(spark, sf_dir)
    return E.expansion(cited, acts, acts.filter("norm_id % 5 = 0").select(F.regexp_replace("url", "^http:", "https:").alias("url")))
