"""Acts written out of line items, read again: roles and routes of articles, and references to annexes over several units."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import structure as S
from attesta.plans.registry import query
from attesta.sources.tables import table


#: Line items that a task gets, about.
TASK_ROWS = 1 << 19


def lines(spark, sf_dir):
    """One row for each number of an order: l_orderkey, place, p, s.

    Whole orders are dealt to as many tasks as the count of line items calls for, and are summed up and, by what follows, put together
    there: tasks by the bytes that are shuffled would grow, as these texts and numbers shrink to a fraction in a shuffle, and so would
    sums by key that begin before it, with the size of a file's part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), "l_partkey", "l_suppkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_ROWS))
    return li.repartition(parts, "l_orderkey").groupBy("l_orderkey", "place").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))


LINES_SQL = "li AS (SELECT l_orderkey, l_linenumber AS place, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"


@query("article_roles", f"""WITH RECURSIVE {LINES_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS i, p % 23 = 0 AS annex, 1 + p % 12 AS num, p % 3 = 0 AS gives, CASE WHEN p % 6 = 0 THEN 1 + s % 7 END AS named, s % 5 = 0 AS quoted FROM li),
walk(l_orderkey, i, place, role, doubt, route, box, art, gives, named, body, given) AS (
  SELECT DISTINCT l_orderkey, 0::BIGINT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM a
  UNION ALL
  SELECT l_orderkey, i, place, role, doubt, CASE WHEN annex THEN 'annex-' || i WHEN role = 'ENACTING' THEN coalesce(box || '/', '') || 'article-' || num ELSE art || '/article-' || num || '[' || lower(role) || ':' || i || ']' END,
    CASE WHEN annex THEN 'annex-' || i ELSE box END, CASE WHEN annex THEN NULL WHEN role = 'ENACTING' THEN coalesce(box || '/', '') || 'article-' || num ELSE art END,
    CASE WHEN annex THEN false WHEN role = 'ENACTING' THEN gives2 ELSE gives END, CASE WHEN annex THEN NULL WHEN role = 'ENACTING' THEN named2 ELSE named END,
    CASE WHEN annex THEN NULL WHEN role = 'ENACTING' THEN num ELSE body END, CASE WHEN annex OR role = 'ENACTING' THEN NULL ELSE num END
  FROM (SELECT *, CASE WHEN annex OR art IS NULL THEN 'ENACTING' WHEN NOT gives THEN CASE WHEN num <= body THEN 'QUOTED' ELSE 'ENACTING' END WHEN num = named OR quoted OR num <= body THEN 'SUBSTITUTED'
      WHEN coalesce(num = body + 1, false) AND NOT coalesce(num = given + 1, false) THEN 'ENACTING' ELSE 'SUBSTITUTED' END AS role,
    CASE WHEN annex OR art IS NULL THEN NULL WHEN NOT gives THEN CASE WHEN num <= body THEN 'NUMBERS_GO_BACK' END WHEN coalesce(num = named, false) OR quoted OR num <= body THEN NULL
      WHEN coalesce(num = body + 1, false) = coalesce(num = given + 1, false) THEN 'BODY_OR_GIVEN_TEXT' END AS doubt
    FROM (SELECT a.l_orderkey, a.i, a.place, a.annex, a.num, a.quoted, a.gives AS gives2, a.named AS named2, w.box, w.art, w.gives, w.named, w.body, w.given FROM walk w JOIN a ON a.l_orderkey = w.l_orderkey AND a.i = w.i + 1) x) y)
SELECT l_orderkey, place::INT AS place, role, doubt, route FROM walk WHERE i > 0""")
def article_roles(spark, sf_dir):
    """Articles that go on, go back, quote and give other acts' articles, and annexes that count anew."""
    p, s = F.col("p"), F.col("s")
    gives = F.when(p % 6 == 0, F.concat(F.lit("Sustitúyese el artículo "), (1 + s % 7).cast("string"), F.lit(" de la Ley"))).when(p % 3 == 0, "Modifícanse los que siguen").otherwise("Rige desde hoy")
    article = F.concat(F.element_at(F.array(F.lit("ARTÍCULO "), F.lit("Art. "), F.lit("Artículo N° ")), (s % 3 + 1).cast("int")), (1 + p % 12).cast("string"), F.lit("°.- "), gives, F.lit("."))
    told = lines(spark, sf_dir).select("l_orderkey", "place", F.when(p % 23 == 0, "ANEXO").otherwise(article).alias("text"), (s % 5 == 0).alias("quoted"))
    return S.segmented(told, "l_orderkey").select("l_orderkey", "place", "role", "doubt", "route")


@query("annex_remissions", rf"""WITH {LINES_SQL}, u AS (SELECT l_orderkey, place, CASE p % 4 WHEN 0 THEN 'Visto. Apruébase el Anexo IF-2025-' || p || '-GCABA-' WHEN 1 THEN 'SSGDA el cual forma' WHEN 2 THEN 'parte integrante de la presente. El ANEXO' ELSE 'que se aprueba rige' END AS t FROM li),
w AS (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY place) AS whole FROM u GROUP BY l_orderkey), st AS (SELECT l_orderkey, place, sum(length(t) + 1) OVER (PARTITION BY l_orderkey ORDER BY place) - length(t) - 1 AS o FROM u),
k AS (SELECT l_orderkey, unnest(string_split(whole, '.')) AS piece, generate_subscripts(string_split(whole, '.'), 1) AS i FROM w),
g AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY l_orderkey ORDER BY i) - length(piece) - 1 AS o FROM k),
f AS (SELECT * FROM g WHERE regexp_matches(piece, '(?is)\banexos?\b.*\b(?:forman?\s+parte\s+integrante|se\s+aprueban?)\b'))
SELECT f.l_orderkey, f.o::BIGINT AS "offset", arg_max(st.place, st.o)::INT AS unit, trim(regexp_replace(any_value(piece), '\s+', ' ', 'g')) AS sentence,
 nullif(regexp_replace(regexp_extract(any_value(piece), '\bIF-\d{{4}}-\d+-GCABA-\s*[A-Z]+\b'), '\s+', '', 'g'), '') AS identifier FROM f JOIN st ON st.l_orderkey = f.l_orderkey AND st.o <= f.o GROUP BY ALL""")
def annex_remissions(spark, sf_dir):
    """Sentences that begin in one unit and end in a later one, or never do."""
    p = F.col("p")
    text = (
        F.when(p % 4 == 0, F.concat(F.lit("Visto. Apruébase el Anexo IF-2025-"), p.cast("string"), F.lit("-GCABA-"))).when(p % 4 == 1, "SSGDA el cual forma")
        .when(p % 4 == 2, "parte integrante de la presente. El ANEXO").otherwise("que se aprueba rige")
    )
    units = lines(spark, sf_dir).select("l_orderkey", "place", text.alias("t"))
    return S.remissions(units, "l_orderkey", "place", "place", "t")
