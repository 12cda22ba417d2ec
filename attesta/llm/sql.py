"""SQL for the numbered queries that SQL can express."""

from __future__ import annotations


def filter_audit_sql() -> str:
    """op12: every document's flags under 120 orders."""
    words = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
told AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {{
    'A': len({words}) < 50,
    'B': 100 * len(list_distinct({words})) < 65 * len({words}),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(first < texts.doc_id, false)}} AS fails
  FROM texts JOIN firsts USING (t) LEFT JOIN told ON told.doc_id = texts.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, k AS step, filter_order[k] AS f, filter_order[1:k - 1] AS earlier FROM orders, range(1, 6) r(k)),
seen AS (
  SELECT part, filter_order, step, f, good, toxic, fails[f] AS here, len(map_values(fails).list_filter(lambda x: x)) AS n_fails,
    len(string_split(earlier, '').list_filter(lambda x: x <> '' AND fails[x])) > 0 AS gone
  FROM flags, steps),
counts AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT here) AS kept, count(*) FILTER (here AND NOT gone) AS removed,
    count(*) FILTER (here AND gone) AS redundant, count(*) FILTER (here AND n_fails = 1) AS unique_fails,
    count(*) FILTER (here AND NOT gone AND good) AS good_lost, count(*) FILTER (here AND NOT gone AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts"""


def merkle_sql(levels: int = 14, upper: int = 7) -> str:
    """op13, for up to 3 ** levels documents of a source and 3 ** upper sources: a CTE a level of nodes, and one of rows that climb."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"list_reduce([ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda crc, b: list_reduce(range(8), {bit}, xor(crc, b)), 4294967295::BIGINT)"
    parts = [
        "raw AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, "
        f"CASE WHEN (4294967295 - {crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)",
        f"hashed AS MATERIALIZED (SELECT doc_id, g, {leaf('text')} AS leaf, {leaf('changed')} AS tampered FROM raw)",
        "n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n, leaf AS d, doc_id, tampered FROM hashed)",
        "r0 AS MATERIALIZED (SELECT doc_id, g, p, d AS leaf, tampered AS f, '' AS sides FROM n0)",
    ]
    last = levels + upper
    for k in range(last + 1):
        if k == levels:  # the subroots are the leaves of the upper tree
            parts.append(f"top AS MATERIALIZED (SELECT 0 AS g, g AS p, count(*) OVER () AS n, d FROM n{k})")
            parts.append(f"rows_up AS MATERIALIZED (SELECT r.doc_id, 0 AS g, r.g AS p, leaf, f, sides, d AS subroot FROM r{k} r JOIN n{k} USING (g))")
        nodes = "top" if k == levels else f"n{k}"
        rows = "rows_up" if k == levels else f"r{k}"
        if k == last:
            break
        sub = ", subroot" if k >= levels else ""
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT a.g, a.p, any_value(a.n) AS n, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before, "
            f"coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after FROM {nodes} a JOIN {nodes} b ON a.g = b.g AND a.p // 3 = b.p // 3 GROUP BY a.g, a.p)"
        )
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT doc_id, g, p // 3 AS p, leaf, CASE WHEN n = 1 THEN f ELSE sha256(before || f || after) END AS f, "
            f"sides || before || after AS sides{sub} FROM {rows} JOIN s{k} USING (g, p))"
        )
        parts.append(
            f"n{k + 1} AS MATERIALIZED (SELECT g, p // 3 AS p, (any_value(n) + 2) // 3 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d "
            f"FROM {nodes} GROUP BY g, p // 3)"
        )
    done = f"SELECT doc_id, leaf, subroot, d AS root, sha256(sides) AS proof_sha256, f AS folded_root, f = d AS verified FROM r{last} JOIN n{last} USING (g)"
    return "WITH " + ",\n".join(parts) + "\n" + done
