"""Functions for spark.sql: the temporal predicates as scalar functions, reasons and servable facts as table functions. Bodies are SQL, so they are
inlined into the plan of whoever calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

RANGE = "kind STRING, starts DATE, ends DATE"
#: name: parameters, type, body.
SCALARS = {
    "range_resolved": (RANGE, "BOOLEAN", "kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND NOT (starts IS NULL AND ends IS NULL)"),
    "range_holds": (
        f"{RANGE}, day DATE", "BOOLEAN",
        "kind NOT IN ('UNKNOWN', 'CONDITIONAL') AND NOT (starts IS NULL AND ends IS NULL) AND (starts IS NULL OR day >= starts) AND (ends IS NULL OR day <= ends)",
    ),
    "known_on": ("since DATE, until DATE, day DATE", "BOOLEAN", "since <= day AND (until IS NULL OR until > day)"),
    "full_year": ("two INT", "INT", "CASE WHEN two >= 100 THEN two WHEN two > 40 THEN two + 1900 ELSE two + 2000 END"),
    "field_state": ("state STRING", "STRING", "coalesce(state, 'NOT_EVALUATED')"),
}
#: name: parameters, columns, body. Reasons are those that a version's own row tells; servable facts read the views named in VIEWS.
TABLES = {
    "own_reasons": (
        "review_state STRING, kind STRING, starts DATE, ends DATE, since DATE, until DATE, verified DATE, reverify DATE, valid_day DATE, known_day DATE",
        "reason STRING",
        """SELECT r FROM (SELECT explode(array_compact(array(
  CASE WHEN review_state <> 'PUBLISHED' THEN 'NOT_PUBLISHED' END, CASE WHEN NOT (since <= known_day AND (until IS NULL OR until > known_day)) THEN 'NOT_KNOWN_THEN' END,
  CASE WHEN kind IN ('UNKNOWN', 'CONDITIONAL') OR (starts IS NULL AND ends IS NULL) THEN 'RANGE_UNRESOLVED' WHEN valid_day < starts OR valid_day > ends THEN 'OUTSIDE_RANGE' END,
  CASE WHEN verified IS NULL THEN 'NOT_VERIFIED' WHEN reverify <= known_day THEN 'STALE' END))) AS r)""",
    ),
    "served_on": (
        "valid_day DATE, known_day DATE",
        "entity_id BIGINT, version_id BIGINT",
        """SELECT v.entity_id, v.version_id FROM attesta_versions v WHERE v.review_state = 'PUBLISHED' AND range_holds(v.valid_kind, v.valid_from, v.valid_to, valid_day)
  AND known_on(v.known_from, v.known_to, known_day) AND v.verified_on IS NOT NULL AND NOT coalesce(v.reverify_on <= known_day, false)
  AND v.release_no IN (SELECT release_no FROM attesta_releases WHERE state = 'PUBLISHED')""",
    ),
}
VIEWS = ("attesta_versions", "attesta_releases")


def register(spark: SparkSession, **views) -> None:
    """Make the functions known to a session, and views (DataFrames by name) under attesta_<name> for those that read tables."""
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"attesta_{name}")
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        if "attesta_" not in body or all(spark.catalog.tableExists(v) for v in VIEWS):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
