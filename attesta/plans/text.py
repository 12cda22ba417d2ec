"""Text and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import identity, text
from attesta.plans.registry import query
from attesta.sources.tables import table

SPACE = r"[ \t\r\n]+"
BLOCKS_SQL = rf"""b AS (SELECT page_id, url, html, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)[ >].*?</(script|style)>', ' ', 'g'), '{SPACE}', ' ', 'g'), '</?({text.BLOCK_TAGS})([ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM pages)"""


@query("html_paragraphs", f"WITH {BLOCKS_SQL} SELECT page_id, unnest(range(len(ps)))::INT AS place, sha256(unnest(ps)) AS block FROM b")
def html_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.paragraphs("html")).alias("place", "block")).select("page_id", "place", F.sha2("block", 256).alias("block"))


@query("html_links", """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS t FROM pages), h AS (SELECT page_id, url, regexp_replace(t, '#.*$', '') AS t FROM l)
SELECT page_id, CASE WHEN regexp_matches(t, '^https?://') THEN t WHEN t LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || t ELSE
 CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+(?:/.*)?/)', 1) = '' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+(?:/.*)?/)', 1) END || t END AS link, count(*) AS n FROM h GROUP BY ALL""")
def html_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(text.links("html")).alias("t"))
    return found.select("page_id", text.absolute(F.col("url"), F.col("t")).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("anchors", r"""SELECT page_id, CASE WHEN regexp_matches(html, '<h1[ >]') AND regexp_matches(html, '<article[ >]') THEN 'RESOLVED' WHEN html IS NULL OR html = '' THEN 'NO_CAPTURE' ELSE 'BROKEN' END AS state FROM pages""")
def anchors(spark, sf_dir):
    """Whether the elements that a page's reading hangs on are there; never by similarity."""
    h = F.col("html")
    state = F.when(h.rlike("<h1[ >]") & h.rlike("<article[ >]"), "RESOLVED").when(h.isNull() | (h == ""), "NO_CAPTURE").otherwise("BROKEN")
    return table(spark, sf_dir, "pages").select("page_id", state.alias("state"))


LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS place FROM documents WHERE text IS NOT NULL)"


def lines(spark, sf_dir):
    return text.lines(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")


@query("line_rejoin", rf"""WITH {LINES_SQL}, o AS (SELECT *, CASE WHEN NOT regexp_matches(lag(line) OVER w, '[.:;!?]\s*$') AND regexp_matches(line, '^\s*[a-z(]') THEN 0 ELSE 1 END AS opens FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
k AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS block FROM o) SELECT doc_id, block::BIGINT AS block, min(place) AS first_place, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM k GROUP BY doc_id, block""")
def line_rejoin(spark, sf_dir):
    return text.joined_lines(lines(spark, sf_dir), "doc_id")


LEVELS = [("title", r"^[A-Z][^ a-z]+() "), ("article", r"^[AEIOU]()"), ("item", r"^([a-z])")]  # an empty group: no number of its own


@query("segment_units", rf"""WITH {LINES_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^(?:[A-Z][^ a-z]+) ') THEN 'title' WHEN regexp_matches(line, '^[AEIOU]') THEN 'article' WHEN regexp_matches(line, '^([a-z])') THEN 'item' END AS kind FROM ln),
c AS (SELECT *, max(place) FILTER (WHERE kind = 'title') OVER w AS p0, max(place) FILTER (WHERE kind = 'article') OVER w AS p1, max(place) FILTER (WHERE kind = 'item') OVER w AS p2, count(*) FILTER (WHERE kind = 'title') OVER w AS n0, count(*) FILTER (WHERE kind = 'article') OVER w AS n1 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
i AS (SELECT c.*, substr(l.line, 1, 1) AS letter FROM c LEFT JOIN ln l ON l.doc_id = c.doc_id AND l.place = c.p2),
r AS (SELECT doc_id, concat_ws('/', CASE WHEN p0 IS NOT NULL THEN 'title-' || n0 END, CASE WHEN p1 >= coalesce(p0, -1) THEN 'article-' || n1 END, CASE WHEN p2 >= greatest(coalesce(p0, -1), coalesce(p1, -1)) THEN 'item-' || letter END) AS route FROM i)
SELECT doc_id, route, count(*) AS n FROM r GROUP BY ALL""")
def segment_units(spark, sf_dir):
    return text.units(lines(spark, sf_dir), "doc_id", LEVELS).groupBy("doc_id", "route").agg(F.count("*").alias("n"))


PHONE = r"[+]?[0-9]*[ ]?[(]?[0-9]{2,4}[)]?[ -][0-9]{3,4}[ -][0-9]{3,4}"


@query("phone_norm", f"WITH p AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{PHONE}')), '[^0-9]', '', 'g') AS phone FROM documents) SELECT DISTINCT doc_id, phone FROM p WHERE length(phone) BETWEEN 8 AND 13")
def phone_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.phones("text")).alias("phone"))


@query("date_ranges", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 300)::INT AS e, o_orderkey % 3 AS kind FROM orders)
SELECT o_orderkey, CASE WHEN kind <> 2 THEN s::VARCHAR END AS starts, CASE WHEN kind <> 2 THEN e::VARCHAR END AS ends, CASE kind WHEN 0 THEN 'GIVEN' WHEN 1 THEN 'DERIVED' ELSE 'PENDING' END AS state FROM o""")
def date_ranges(spark, sf_dir):
    """Ranges written out in words, with both years, the first year only, or none, and read again."""
    names = F.array(*(F.lit(n) for n in ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")))
    start = F.to_date("o_orderdate")
    end, kind = F.date_add(start, (F.col("o_orderkey") % 300).cast("int")), F.col("o_orderkey") % 3
    said = lambda d, year: F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), names[F.month(d) - 1], F.when(year, F.concat(F.lit(" de "), F.year(d).cast("string"))).otherwise(""))
    told = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Vale del "), said(start, kind < 2), F.lit(" al "), said(end, kind == 0)).alias("told"))
    read = told.select("o_orderkey", text.date_range("told").alias("r"))
    return read.select("o_orderkey", F.col("r.start").cast("string").alias("starts"), F.col("r.end").cast("string").alias("ends"), F.col("r.state").alias("state"))


@query("amount_table", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS since, round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR AS amount FROM orders")
def amount_table(spark, sf_dir):
    price = F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", ".,")
    told = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Importe a partir del "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(": $ "), price, F.lit(" por mes")).alias("told"))
    return text.amounts(told, "o_orderkey", "told").select("o_orderkey", F.col("since").cast("string"), F.col("amount").cast("string"))


@query("identity_resolution", """WITH m AS (SELECT o_orderkey AS mention_id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey END AS official_id, CASE WHEN o_orderkey % 17 <> 0 THEN 'Brand#' || (o_custkey % 30) END AS place, (o_orderkey % 50 + 1)::INT AS number, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 7 END AS year FROM orders),
c AS (SELECT p_partkey AS norm_id, p_brand AS place, p_size AS number, p_partkey % 7 AS year FROM part), f AS (SELECT place, number, year, count(*) AS fn, min(norm_id) AS fid FROM c GROUP BY ALL), p AS (SELECT place, number, count(*) AS pn, min(norm_id) AS pid FROM c GROUP BY ALL),
o AS (SELECT m.*, fn, fid, pn, pid, c.norm_id AS known, CASE WHEN m.place IS NULL THEN 'REFUSED' WHEN c.norm_id IS NOT NULL THEN 'OFFICIAL' WHEN fn = 1 THEN 'FULL_KEY' WHEN fn > 1 THEN 'AMBIGUOUS' WHEN m.year IS NULL AND pn = 1 THEN 'UNIQUE_NUMBER' WHEN m.year IS NULL AND pn > 1 THEN 'AMBIGUOUS' WHEN m.year IS NULL THEN 'NEW_UNCERTAIN' ELSE 'NEW' END AS outcome
 FROM m LEFT JOIN c ON c.norm_id = official_id LEFT JOIN f ON f.place = m.place AND f.number = m.number AND f.year = m.year LEFT JOIN p ON p.place = m.place AND p.number = m.number)
SELECT mention_id, CASE outcome WHEN 'OFFICIAL' THEN known WHEN 'FULL_KEY' THEN fid WHEN 'UNIQUE_NUMBER' THEN pid END AS norm_id, outcome FROM o""")
def identity_resolution(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mentions = table(spark, sf_dir, "orders").select(
        k.alias("mention_id"), F.when(k % 9 == 0, k).alias("official_id"), F.when(k % 17 != 0, F.concat(F.lit("Brand#"), (c % 30).cast("string"))).alias("place"),
        (k % 50 + 1).cast("int").alias("number"), F.when(k % 4 != 0, c % 7).alias("year"),
    )
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("norm_id"), F.col("p_brand").alias("place"), F.col("p_size").alias("number"), (F.col("p_partkey") % 7).alias("year"))
    return identity.resolve(mentions, catalogue)


@query("joint_issue", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_suppkey, l_linenumber) AS l_suppkey, count(*) AS n_rows, count(DISTINCT l_suppkey) - 1 AS n_others FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def joint_issue(spark, sf_dir):
    """One row an order with the first supplier; the further suppliers are counted."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    return identity.single(rows, "l_orderkey", "l_linenumber", "l_suppkey")


@query("source_contrast", """WITH r AS (SELECT l_partkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_tax END AS v FROM lineitem), g AS (SELECT l_partkey, l_returnflag, count(v) AS n, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL)
SELECT l_partkey, l_returnflag, CASE WHEN n = 0 THEN 'SILENT' WHEN lo <> hi THEN 'CONFLICT' WHEN n = 1 THEN 'ONLY_ONE' ELSE 'AGREE' END AS state, CASE WHEN lo = hi THEN lo END AS value FROM g""")
def source_contrast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("v"))
    return identity.contrast(rows, "l_partkey", "l_returnflag", "v")
