"""Relational queries: filters, joins, aggregates, windows, pages, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import relational as r
from attesta.plans.registry import query
from attesta.sources.shared import numbered
from attesta.sources.tables import INCIDENTS_SQL, RELEASES_SQL, VERSIONS_SQL, incidents, releases, table, versions


@query("optional_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filter(spark, sf_dir):
    wanted = r.optional(o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)
    return table(spark, sf_dir, "orders").filter(wanted).select("o_orderkey", "o_custkey")


@query("array_membership", "WITH m AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS ps FROM orders GROUP BY o_custkey) SELECT o_custkey FROM m WHERE list_contains(ps, '1-URGENT') AND len(ps) < 5")
def array_membership(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"))
    return m.filter(F.array_contains("ps", "1-URGENT") & (F.size("ps") < 5)).select("o_custkey")


@query("pattern_ci", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A1%' OR p_type ILIKE '%steel'")
def pattern_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%A1%") | F.col("p_type").ilike("%steel")).select("p_partkey", "p_name")


@query("regex_predicate", r"SELECT page_id FROM pages WHERE regexp_matches(html, '<(p|div|table|ul)[ >]')")
def regex_predicate(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("html").rlike("<(p|div|table|ul)[ >]")).select("page_id")


@query("listing_label", "SELECT o_orderkey, o_orderpriority || ' / ' || o_orderstatus || coalesce(' (' || nullif(o_orderstatus, 'F') || ')', '') AS label FROM orders")
def listing_label(spark, sf_dir):
    extra = F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit(")")), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus", extra).alias("label"))


@query("scope_hint", """WITH c AS (SELECT n_nationkey, n_name, count(c_custkey) FILTER (WHERE c_acctbal > 9900) AS found, count(c_custkey) AS others FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, found, CASE WHEN found = 0 THEN others END AS others_hint FROM c""")
def scope_hint(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_nationkey", "n_name").agg(F.count_if(F.col("c_acctbal") > 9900).alias("found"), F.count("c_custkey").alias("others"))
    return counts.select("n_name", "found", F.when(F.col("found") == 0, F.col("others")).alias("others_hint"))


@query("rule_class", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'PARAMETER_WITHOUT_VALUE' WHEN o_orderkey % 3 = 0 AND o_orderpriority LIKE '1%' THEN 'ACCESS' WHEN o_orderkey % 3 = 0 THEN 'CONDITION'
WHEN o_orderpriority LIKE '1%' THEN 'ACCESS_WITHOUT_CONDITION' ELSE 'INFORMATIVE' END AS pile FROM orders""")
def rule_class(spark, sf_dir):
    condition, access = F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority").startswith("1")
    pile = F.when(condition & (F.col("o_orderstatus") == "P"), "PARAMETER_WITHOUT_VALUE").when(condition & access, "ACCESS").when(condition, "CONDITION").when(access, "ACCESS_WITHOUT_CONDITION").otherwise("INFORMATIVE")
    return table(spark, sf_dir, "orders").select("o_orderkey", pile.alias("pile"))


@query("source_verdict", """SELECT source, CASE WHEN count(*) < 60 THEN 'NOT_RUN' WHEN count(DISTINCT text) < 0.9 * count(*) THEN 'REPEATS' WHEN max(n_chars) > 20000 THEN 'SERVES_LONG' ELSE 'SERVES' END AS verdict, count(*) AS n FROM documents GROUP BY source""")
def source_verdict(spark, sf_dir):
    g = table(spark, sf_dir, "documents").withColumn("h", F.md5("text")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("h").alias("d"), F.max("n_chars").alias("m"))
    return g.select("source", F.when(F.col("n") < 60, "NOT_RUN").when(F.col("d") < 0.9 * F.col("n"), "REPEATS").when(F.col("m") > 20000, "SERVES_LONG").otherwise("SERVES").alias("verdict"), "n")


@query("url_pattern", "SELECT page_id, url FROM pages WHERE url LIKE 'http%' AND NOT contains(url, '{') AND (url LIKE '%1%' OR url LIKE '%/2%')")
def url_pattern(spark, sf_dir):
    u = F.col("url")
    patterns = u.like("%1%") | u.like("%/2%")
    return table(spark, sf_dir, "pages").filter(u.startswith("http") & ~u.contains("{") & patterns).select("page_id", "url")


@query("owner_resolution", "SELECT l_orderkey, l_linenumber, coalesce(c_name, s_name) AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = l_suppkey")
def owner_resolution(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer").filter("c_acctbal > 0"), table(spark, sf_dir, "supplier")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"], "left").join(s, li["l_suppkey"] == s["s_suppkey"], "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("c_name", "s_name").alias("owner"))


@query("latest_trace_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_trace_per_key(spark, sf_dir):
    return r.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("previous_version", f"WITH {VERSIONS_SQL} SELECT version_id, lag(version_id) OVER (PARTITION BY entity_id ORDER BY version_no) AS previous_id FROM versions")
def previous_version(spark, sf_dir):
    return versions(spark, sf_dir).select("version_id", F.lag("version_id").over(Window.partitionBy("entity_id").orderBy("version_no")).alias("previous_id"))


@query("version_pairs", f"WITH {VERSIONS_SQL} SELECT a.entity_id, a.version_id AS old_id, b.version_id AS new_id FROM versions a FULL JOIN versions b ON a.entity_id = b.entity_id AND a.version_no = b.version_no - 2 WHERE coalesce(a.version_no, 1) = 1 AND coalesce(b.version_no, 3) = 3")
def version_pairs(spark, sf_dir):
    v = versions(spark, sf_dir)
    a = v.select(F.col("entity_id").alias("entity_id"), F.col("version_id").alias("old_id"), F.col("version_no").alias("a_no"))
    b = v.select(F.col("entity_id").alias("b_entity"), F.col("version_id").alias("new_id"), F.col("version_no").alias("b_no"))
    pairs = a.join(b, (a["entity_id"] == b["b_entity"]) & (F.col("a_no") == F.col("b_no") - 2), "full")
    return pairs.filter((F.coalesce("a_no", F.lit(1)) == 1) & (F.coalesce("b_no", F.lit(3)) == 3)).select("entity_id", "old_id", "new_id")


@query("semi_anti", f"WITH {VERSIONS_SQL}, {INCIDENTS_SQL} SELECT version_id FROM versions v WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = version_id AND l_quantity > 40) AND NOT EXISTS (SELECT 1 FROM incidents i WHERE i.version_id = v.version_id AND i.state <> 'CLOSED')")
def semi_anti(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("version_id"))
    blockers = incidents(spark, sf_dir).filter("state <> 'CLOSED'")
    return versions(spark, sf_dir).join(evidence, "version_id", "left_semi").join(blockers, "version_id", "left_anti").select("version_id")


@query("nested_anti", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = o_orderkey AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = a.l_suppkey AND s_acctbal > 0))")
def nested_anti(spark, sf_dir):
    valued = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    without = table(spark, sf_dir, "lineitem").join(valued, "l_suppkey", "left_anti").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(without, "o_orderkey", "left_semi").select("o_orderkey")


FLOWS_SQL = """flows AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.09)"""


def flows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09")
    joined = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()


#: Customers are even nodes, suppliers odd ones.
PARTIES_SQL = """flows AS (SELECT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 2 * l_suppkey + 1, 2 * o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""


def parties(spark, sf_dir):
    """Who buys from whom, and who takes goods back from whom, over all line items: nodes and edges grow with the tables."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sides = joined.select((2 * F.col("o_custkey")).alias("c"), (2 * F.col("l_suppkey") + 1).alias("s"), "l_returnflag")
    return sides.select(F.col("c").alias("a"), F.col("s").alias("b")).union(sides.filter("l_returnflag = 'R'").select("s", "c")).distinct()


@query("mutual_links", f"WITH {FLOWS_SQL} SELECT x.a, x.b FROM flows x JOIN flows y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_links(spark, sf_dir):
    return mutual(flows(spark, sf_dir))


@query("party_mutual_links", f"WITH {PARTIES_SQL} SELECT x.a, x.b FROM flows x JOIN flows y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def party_mutual_links(spark, sf_dir):
    return mutual(parties(spark, sf_dir))


def mutual(edges):
    f = edges.filter("a <> b")
    both = f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("up"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")


@query("union_directions", f"WITH {FLOWS_SQL} SELECT a AS node, b AS other, 'OUT' AS direction FROM flows UNION ALL SELECT b, a, 'IN' FROM flows")
def union_directions(spark, sf_dir):
    return directions(flows(spark, sf_dir))


@query("party_directions", f"WITH {PARTIES_SQL} SELECT a AS node, b AS other, 'OUT' AS direction FROM flows UNION ALL SELECT b, a, 'IN' FROM flows")
def party_directions(spark, sf_dir):
    return directions(parties(spark, sf_dir))


def directions(f):
    return f.select(F.col("a").alias("node"), F.col("b").alias("other"), F.lit("OUT").alias("direction")).union(f.select("b", "a", F.lit("IN")))


@query("union_distinct", "SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return a.union(table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_orderkey")).distinct()


@query("set_difference", "WITH l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P') (SELECT id, 'LEFT' AS side FROM l EXCEPT SELECT id, 'LEFT' FROM o) UNION ALL (SELECT id, 'RIGHT' FROM o EXCEPT SELECT id, 'RIGHT' FROM l)")
def set_difference(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    right = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return r.difference(left, right, ["id"])


@query("full_outer", "SELECT coalesce(x.k, y.k) AS k, x.n AS customers, y.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) y ON x.k = y.k")
def full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full")


@query("filtered_aggregates", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, count(DISTINCT user_id) AS users, bool_or(value > 99) AS any_extreme, min(event_id) AS first_id, max(event_id) AS last_id, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def filtered_aggregates(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(v > 50).alias("large"), F.count_distinct("user_id").alias("users"), F.bool_or(v > 99).alias("any_extreme"),
        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.avg("value"), 4).alias("mean"),
    )


@query("fanout_guard", "SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def fanout_guard(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


@query("outcome_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def outcome_p95(spark, sf_dir):
    return r.at_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p95": r.discrete_rank("0.95"), "p50": r.discrete_rank("0.5")})


@query("nearest_rank", "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p90 FROM x WHERE i = floor(0.9 * (n - 1) + 0.5)")
def nearest_rank(spark, sf_dir):
    return r.at_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p90": r.nearest_rank("0.9")})


@query("having_duplicates", "SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY ALL HAVING count(*) > 1")
def having_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).filter("n > 1")


@query("scalar_counts", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier")
def scalar_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_partkey").alias("parts"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(li, "s_suppkey", "left").fillna(0)


@query("distinct_on", "SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def distinct_on(spark, sf_dir):
    return r.top_row(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_name")


@query("manifest_hash", f"""WITH {VERSIONS_SQL},
a AS (SELECT release_no, version_id // 4096 AS block, count(*) AS n, sha256('[' || string_agg(version_id::VARCHAR, ',' ORDER BY version_id) || ']') AS h FROM versions WHERE review_state = 'PUBLISHED' GROUP BY ALL),
b AS (SELECT release_no, block // 4096 AS upper_block, sum(n) AS n, sha256('[' || string_agg(h, ',' ORDER BY block) || ']') AS h FROM a GROUP BY ALL)
SELECT release_no, sum(n)::BIGINT AS n, sha256('[' || string_agg(h, ',' ORDER BY upper_block) || ']') AS manifest FROM b GROUP BY release_no""")
def manifest_hash(spark, sf_dir):
    members = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'")
    return r.digests(members, "release_no", "version_id").withColumnRenamed("digest", "manifest")


@query("conciliation", """WITH t AS (SELECT source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS turn FROM documents WHERE n_chars >= 20),
a AS (SELECT source, count(*) AS read, count(*) FILTER (WHERE n_chars < 20) AS rejected FROM documents GROUP BY source),
b AS (SELECT source, count(*) FILTER (WHERE turn = 1) AS fresh, count(*) FILTER (WHERE turn > 1) AS repeated FROM t GROUP BY source)
SELECT a.source, read, coalesce(fresh, 0) AS fresh, coalesce(repeated, 0) AS repeated, rejected, read = coalesce(fresh, 0) + coalesce(repeated, 0) + rejected AS balanced
FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source""")
def conciliation(spark, sf_dir):
    return r.conciliation(table(spark, sf_dir, "documents"), "source", F.sha2("text", 256), F.col("n_chars") >= 20, F.col("n_chars") < 20)


@query("two_pass_duplicates", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size) > 1 AS uncertain FROM part")
def two_pass_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.count("*").over(Window.partitionBy("p_brand", "p_type", "p_size")) > 1).alias("uncertain"))


@query("string_agg", "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def string_agg(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("nations"))


@query("next_version_number", f"WITH {VERSIONS_SQL} SELECT c_custkey AS entity_id, coalesce(max(version_no), 0) + 1 AS next_no FROM customer LEFT JOIN versions ON entity_id = c_custkey GROUP BY c_custkey")
def next_version_number(spark, sf_dir):
    top = versions(spark, sf_dir).groupBy("entity_id").agg(F.max("version_no").alias("m"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    return c.join(top, "entity_id", "left").select("entity_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_no"))


@query("page_with_total", f"WITH {VERSIONS_SQL} SELECT version_id, valid_to::VARCHAR AS valid_to, (SELECT count(*) FROM versions WHERE review_state = 'PUBLISHED') AS total FROM versions WHERE review_state = 'PUBLISHED' ORDER BY versions.valid_to DESC NULLS LAST, version_id LIMIT 50 OFFSET 100")
def page_with_total(spark, sf_dir):
    live = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'").select("version_id", "valid_to")
    return r.page(live, [F.desc_nulls_last("valid_to"), F.col("version_id")], 100, 50).select("version_id", F.col("valid_to").cast("string"), "total")


@query("severity_order", f"WITH {INCIDENTS_SQL} SELECT severity, state, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, state) AS place, n FROM (SELECT severity, state, count(*) AS n FROM incidents GROUP BY ALL)")
def severity_order(spark, sf_dir):
    g = incidents(spark, sf_dir).groupBy("severity", "state").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(r.severity_rank("severity", ("CRITICAL", "HIGH")), "state")))


@query("jurisdiction_marked", "SELECT s_suppkey, s_name, s_nationkey <> 7 AS other, row_number() OVER (ORDER BY s_nationkey <> 7, s_name, s_suppkey) AS place FROM supplier")
def jurisdiction_marked(spark, sf_dir):
    """Every supplier with its mark and its place: those of the nation first, none left out."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") != 7).alias("other"))
    return numbered(s, F.col("other"), F.col("s_name"), F.col("s_suppkey"))


@query("released_counts", f"WITH {VERSIONS_SQL}, {RELEASES_SQL} SELECT r.release_no, r.state, count(v.version_id) AS members FROM releases r LEFT JOIN versions v ON v.release_no = r.release_no AND v.review_state = 'PUBLISHED' GROUP BY ALL")
def released_counts(spark, sf_dir):
    members = versions(spark, sf_dir).filter("review_state = 'PUBLISHED'").groupBy("release_no").agg(F.count("*").alias("members"))
    return releases(spark, sf_dir).join(members, "release_no", "left").select("release_no", "state", F.coalesce("members", F.lit(0)).alias("members"))
