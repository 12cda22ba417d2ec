"""The functions of functions/sql.py, called from spark.sql over the versions, and matched texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import sql
from attesta.operators import graph, similarity
from attesta.plans.registry import query
from attesta.plans.relational import parties
from attesta.plans.temporal import DAY, KNOWN
from attesta.sources.tables import RELEASES_SQL, VERSIONS_SQL, releases, table, versions


def known(spark, sf_dir):
    sql.register(spark, versions=versions(spark, sf_dir), releases=releases(spark, sf_dir))
    return spark


@query("sql_scalars", f"""WITH {VERSIONS_SQL} SELECT version_id, valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AS resolved, valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND DATE '{DAY}' >= valid_from AND (valid_to IS NULL OR DATE '{DAY}' <= valid_to) AS holds,
known_from <= DATE '{KNOWN}' AND (known_to IS NULL OR known_to > DATE '{KNOWN}') AS known, (CASE WHEN version_id % 100 > 40 THEN 1900 ELSE 2000 END + version_id % 100)::INT AS year FROM versions""")
def sql_scalars(spark, sf_dir):
    return known(spark, sf_dir).sql(f"""SELECT version_id, range_resolved(valid_kind, valid_from, valid_to) AS resolved, range_holds(valid_kind, valid_from, valid_to, DATE'{DAY}') AS holds,
        known_on(known_from, known_to, DATE'{KNOWN}') AS known, full_year(cast(version_id % 100 AS INT)) AS year FROM attesta_versions""")


@query("sql_reasons", f"""WITH {VERSIONS_SQL} SELECT version_id, 'NOT_PUBLISHED' AS reason FROM versions WHERE review_state <> 'PUBLISHED'
UNION ALL SELECT version_id, 'NOT_KNOWN_THEN' FROM versions WHERE known_from > DATE '{KNOWN}' OR known_to <= DATE '{KNOWN}'
UNION ALL SELECT version_id, CASE WHEN valid_kind IN ('UNKNOWN', 'CONDITIONAL') THEN 'RANGE_UNRESOLVED' ELSE 'OUTSIDE_RANGE' END FROM versions WHERE valid_kind IN ('UNKNOWN', 'CONDITIONAL') OR valid_from > DATE '{DAY}' OR valid_to < DATE '{DAY}'
UNION ALL SELECT version_id, CASE WHEN verified_on IS NULL THEN 'NOT_VERIFIED' ELSE 'STALE' END FROM versions WHERE verified_on IS NULL OR reverify_on <= DATE '{KNOWN}'""")
def sql_reasons(spark, sf_dir):
    """A table function in a lateral join: a row for each reason of each version."""
    return known(spark, sf_dir).sql(f"""SELECT v.version_id, r.reason FROM attesta_versions v, LATERAL own_reasons(v.review_state, v.valid_kind, v.valid_from, v.valid_to, v.known_from, v.known_to,
        v.verified_on, v.reverify_on, DATE'{DAY}', DATE'{KNOWN}') r""")


@query("sql_served", f"""WITH {VERSIONS_SQL}, {RELEASES_SQL} SELECT entity_id, version_id FROM versions WHERE review_state = 'PUBLISHED' AND valid_kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND DATE '{DAY}' >= valid_from AND (valid_to IS NULL OR DATE '{DAY}' <= valid_to)
AND known_from <= DATE '{KNOWN}' AND (known_to IS NULL OR known_to > DATE '{KNOWN}') AND verified_on IS NOT NULL AND reverify_on > DATE '{KNOWN}' AND release_no IN (SELECT release_no FROM releases WHERE state = 'PUBLISHED')""")
def sql_served(spark, sf_dir):
    return known(spark, sf_dir).sql(f"SELECT entity_id, version_id FROM served_on(DATE'{DAY}', DATE'{KNOWN}')")


@query("party_on_cycles")
def party_on_cycles(spark, sf_dir):
    """Customers and suppliers of whom goods come back on some way: what is left of the whole graph when its loose ends are taken off."""
    return graph.cyclic(parties(spark, sf_dir))


@query("text_similarity")
def text_similarity(spark, sf_dir):
    """How alike each document and the next one are, by their matching runs of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("later"))
    return docs.join(later, "doc_id").select("doc_id", F.round(similarity.ratio(F.col("text"), F.col("later")), 9).alias("ratio"))
