"""Answers, next steps, completed identities and equivalent units, out of orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import answers as A
from attesta.operators import identity as I
from attesta.operators import rule_contract as R
from attesta.plans.registry import ORACLE, query
from attesta.plans.rule_contract import BENEFITS, facts_on
from attesta.sources.tables import table

MOST = 3


@query("answer_modes", f"""WITH f AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS chunk, 10 - l_linenumber AS place, CASE WHEN l_suppkey % 2 = 0 THEN 'Ley ' ELSE 'Decreto ' END || l_suppkey || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ', art. ' || l_linenumber END AS head, ' ' || l_shipdate::DATE || ' ' AS text FROM lineitem WHERE l_returnflag <> 'N'),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, chunk, head, text) AS turn FROM f),
e AS (SELECT q, string_agg('**' || head || '** [[chunk:' || chunk || ']]' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS extract, string_agg(chunk::VARCHAR, ',' ORDER BY turn) AS cites FROM k WHERE turn <= {MOST} GROUP BY q),
m AS (SELECT o_orderkey, e.*, CASE WHEN q IS NULL THEN 'ABSTAINED' WHEN o_orderkey % 3 = 0 THEN 'EXTRACT' WHEN o_orderkey % 5 = 0 THEN 'EXTRACT' ELSE 'WRITTEN' END AS mode FROM orders LEFT JOIN e ON q = o_orderkey)
SELECT o_orderkey AS query_id, mode, CASE WHEN mode = 'ABSTAINED' THEN 'NO_EVIDENCE' WHEN mode = 'EXTRACT' AND o_orderkey % 3 > 0 THEN 'DRAFT_REFUSED' END AS reason, sha256(CASE mode WHEN 'WRITTEN' THEN 'draft ' || o_orderkey WHEN 'EXTRACT' THEN extract END) AS answer, coalesce(cites, '') AS cites FROM m""")
def answer_modes(spark, sf_dir):
    """Orders as queries: a third without a draft, a fifth with a faulty one; line items that came back are their evidence."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("query_id"), F.when(k % 3 > 0, F.concat(F.lit("draft "), k.cast("string"))).alias("draft"), F.when(k % 5 == 0, "FOREIGN_LINK").otherwise("VALID").alias("fault"))
    act = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Ley ").otherwise("Decreto "), F.col("l_suppkey").cast("string"))
    unit = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("art. "), F.col("l_linenumber").cast("string")))
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("query_id"), (10 - F.col("l_linenumber")).alias("place"), F.col("l_partkey").alias("chunk_id"), act.alias("act"), unit.alias("unit"), F.concat(F.lit(" "), F.to_date("l_shipdate").cast("string"), F.lit(" ")).alias("text"),
    )
    got = A.answers(asked, found.distinct(), MOST)
    return got.select("query_id", "mode", "reason", F.sha2("answer", 256).alias("answer"), F.array_join("cites", ",").alias("cites"))


def procedures(spark, sf_dir):
    """The steps of both benefits' procedures: an order each of the urgent ones, of which some aren't published."""
    region = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    return region.select(F.when(n % 2 == 0, "first").otherwise("second").alias("benefit"), F.concat(F.lit("T"), (n % 3).cast("string")).alias("title"), n.alias("step_no"), F.col("n_name").alias("step"), F.when(n % 4 < 2, "PUBLISHED").otherwise("CANDIDATE").alias("review"))


@query("next_steps", f"""WITH v AS ({ORACLE['contract_verdicts']}), p AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS benefit, n_name AS step, 'T' || n_nationkey % 3 AS title, n_nationkey AS no FROM nation WHERE n_nationkey % 4 < 2),
s AS (SELECT c_custkey, benefit, 1 AS a, 0 AS b, 'QUESTION' AS origin, string_split(questions, ',')[1] AS step FROM v WHERE questions <> ''
 UNION ALL SELECT c_custkey, benefit, 2, i, 'EXCEPTION', string_split(w, '/')[2] FROM (SELECT c_custkey, benefit, unnest(string_split(remedies, ',')) AS w, generate_subscripts(string_split(remedies, ','), 1) AS i FROM v) x WHERE w LIKE '%/UNKNOWN'
 UNION ALL SELECT c_custkey, benefit, 3, row_number() OVER (PARTITION BY c_custkey, benefit ORDER BY title, no), 'PROCEDURE', step FROM v JOIN p USING (benefit))
SELECT c_custkey AS person, benefit, row_number() OVER (PARTITION BY c_custkey, benefit ORDER BY a, b)::INT AS place, origin, step FROM s""")
def next_steps(spark, sf_dir):
    """What each customer can do next for each benefit."""
    asked = facts_on(spark, sf_dir)
    found = [R.verdicts(asked, rules, ["c_custkey"]).withColumn("benefit", F.lit(b)) for b, rules in BENEFITS.items()]
    return A.next_steps(found[0].unionByName(found[1]).withColumnRenamed("c_custkey", "person"), procedures(spark, sf_dir))


@query("identity_completion", """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'LEY' ELSE 'DECRETO' END AS type, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::VARCHAR END AS number, year(o_orderdate)::INT AS year, 'Title ' || o_orderkey AS title, o_orderkey % 4 = 0 AS unsure FROM orders),
v AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE WHEN l_orderkey % 2 = 0 THEN 'LEY' ELSE 'DECRETO' END AS type, (CASE WHEN l_orderkey % 4 = 0 OR l_suppkey % 10 = 0 THEN l_suppkey ELSE o_custkey END)::VARCHAR AS number, year(o_orderdate)::INT AS year, CASE WHEN l_partkey % 2 = 0 THEN 'View ' || l_linenumber ELSE '' END AS title
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
u AS (SELECT id, min((place, type, number, year, title)) AS v FROM v GROUP BY id), c AS (SELECT v.id, bool_or(v.number <> a.number) AS differs FROM v JOIN a USING (id) GROUP BY v.id),
o AS (SELECT a.*, u.v, CASE WHEN u.v IS NULL THEN 'KEPT' WHEN unsure THEN 'COMPLETED' WHEN differs THEN 'CONFLICT' ELSE 'KEPT' END AS outcome FROM a LEFT JOIN u USING (id) LEFT JOIN c USING (id))
SELECT id AS norm_id, type, CASE outcome WHEN 'COMPLETED' THEN v[3] ELSE number END AS number, year, CASE WHEN outcome = 'COMPLETED' AND v[5] <> '' THEN v[5] ELSE title END AS title, unsure AND outcome <> 'COMPLETED' AS uncertain, outcome FROM o""")
def identity_completion(spark, sf_dir):
    """Orders as acts, a quarter without a number, and line items that came back as further views of them."""
    k, day = F.col("o_orderkey"), F.year("o_orderdate")
    kind = F.when(k % 2 == 0, "LEY").otherwise("DECRETO").alias("type")
    o = table(spark, sf_dir, "orders")
    acts = o.select(k.alias("norm_id"), kind, F.when(k % 4 != 0, F.col("o_custkey").cast("string")).alias("number"), day.alias("year"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), (k % 4 == 0).alias("uncertain"))
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == k)
    number = F.when((k % 4 == 0) | (F.col("l_suppkey") % 10 == 0), F.col("l_suppkey")).otherwise(F.col("o_custkey")).cast("string")
    title = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("View "), F.col("l_linenumber").cast("string"))).otherwise("")
    once = back.groupBy(k.alias("norm_id"), F.col("l_linenumber").alias("place")).agg(F.min(F.struct(kind, number.alias("number"), day.alias("year"), title.alias("title"))).alias("v"))
    rest = back.select(k.alias("norm_id"), (F.col("l_linenumber") + 100).alias("place"), kind, number.alias("number"), day.alias("year"), title.alias("title"))
    return I.completed(acts, once.select("norm_id", "place", "v.*").unionByName(rest))


@query("unit_equivalence", """WITH d AS (SELECT l_orderkey AS key, l_linenumber AS line, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), e AS (SELECT key, 'title-1/article-' || p % 5 || '/item-' || line AS f, 'title-1/article-' || s % 5 || '/item-' || line AS t, CASE p % 4 WHEN 0 THEN 'MOVED' WHEN 1 THEN 'MODIFIED' WHEN 2 THEN 'REMOVED' ELSE 'ADDED' END AS c, p, s FROM d)
SELECT key, f AS from_route, CASE c WHEN 'MOVED' THEN t ELSE f END AS to_route, CASE c WHEN 'MOVED' THEN 'RENUMBERED' ELSE 'REPLACED' END AS kind, c = 'MOVED' AND p % 5 <> s % 5 AS other_article, CASE WHEN s % 3 = 0 THEN CASE c WHEN 'MOVED' THEN t ELSE f END END AS now FROM e WHERE c IN ('MOVED', 'MODIFIED')""")
def unit_equivalence(spark, sf_dir):
    """Line items as units that moved, changed, went or came; a third of the equivalences is approved and leads citations on."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    route = lambda c: F.concat(F.lit("title-1/article-"), (F.col(c) % 5).cast("string"), F.lit("/item-"), F.col("line").cast("string"))
    change = F.get(F.array(*map(F.lit, ("MOVED", "MODIFIED", "REMOVED", "ADDED"))), F.col("p") % 4)
    diff = d.withColumn("change", change).select("key", "change", route("p").alias("was_route"), F.when(F.col("change") == "MOVED", route("s")).alias("now_route"), "s", "line")
    found = I.equivalences(diff)
    approved = diff.select("key", F.col("was_route").alias("from_route"), F.when(F.col("s") % 3 == 0, "APPROVED").otherwise("CANDIDATE").alias("review"))
    judged = found.join(approved, ["key", "from_route"])
    cites = found.select(F.col("from_route").alias("cite_id"), "key", F.col("from_route").alias("route"))
    return found.join(I.redirected(cites, judged).select("key", F.col("route").alias("from_route"), "now"), ["key", "from_route"])
