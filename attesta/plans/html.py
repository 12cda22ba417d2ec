"""Pages read as trees: blocks with offsets, what pages hide, links with their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import html
from attesta.plans.registry import query
from attesta.sources.tables import table

TAGS = "|".join(sorted(html.BLOCKS, key=lambda t: (-len(t), t)))
BARE = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in sorted(html.IGNORED):
    BARE = f"regexp_replace({BARE}, '(?si)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"
READ = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
BLOCKS_SQL = f"""bare AS (SELECT page_id, {BARE} AS h FROM pages),
cut AS (SELECT page_id, regexp_extract_all(h, '(?i)<(/?(?:{TAGS}))(?:[ /][^>]*)?>', 1) AS tags, regexp_split_to_array(h, '(?i)</?(?:{TAGS})(?:[ /][^>]*)?>') AS texts FROM bare),
parts AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(tags[2:] || ['/end']) AS following, unnest(texts[2:]) AS raw FROM cut),
leaves AS (SELECT page_id, i, trim(regexp_replace({READ.format("regexp_replace(raw, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM parts
  WHERE tag NOT LIKE '/%' AND (following LIKE '/%' OR lower(tag) = 'p' OR (lower(tag) = 'li' AND lower(following) = 'li'))),
blocks AS (SELECT page_id, text, row_number() OVER w - 1 AS place, sum(length(text) + 1) OVER w - length(text) - 1 AS starts FROM leaves WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY i))"""


def trees(spark, sf_dir):
    return html.trees(table(spark, sf_dir, "pages"), keep=("page_id",))


@query("html_blocks", f"""WITH {BLOCKS_SQL} SELECT page_id, place::INT AS place, starts::INT AS "start", (starts + length(text))::INT AS "end", substr(text, 1, 1) IN ('"', '“', '«', '''', '‘') AS quoted, sha256(text) AS block FROM blocks""")
def html_blocks(spark, sf_dir):
    return html.blocks(trees(spark, sf_dir), "page_id").select("page_id", "place", "start", "end", "quoted", F.sha2("text", 256).alias("block"))


@query("html_hidden", f"""SELECT page_id, sha256(trim(regexp_replace({READ.format("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")}, '\\s+', ' ', 'g'))) AS hidden, (page_id % 2)::INT AS blocks_less FROM pages WHERE regexp_matches(html, '(?s)<div class="ad">[^<]*[^<\\s][^<]*</div>')""")
def html_hidden(spark, sf_dir):
    """Pages of which the advertisement is hidden, by its class, a style or an attribute in turn, or as a part of the block around it: what
    they hide, and by how many blocks more those show that hide none."""
    way = F.element_at(F.array(*map(F.lit, ('<div class="ad d-none">', '<div style="Display : None">', '<DIV HIDDEN>', '<div aria-hidden="True">'))), (F.col("page_id") % 4 + 1).cast("int"))
    # on even pages the hidden element is within a block that it doesn't divide, and which has a word of its own
    opened = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<div>seen "), way)).otherwise(way)
    ended = F.when(F.col("page_id") % 2 == 0, F.lit("</div></div>")).otherwise(F.lit("</div>"))
    ad = F.regexp_extract("html", '(?s)<div class="ad">(.*?)</div>', 1)
    plain = F.concat(F.lit('<div class="ad">'), ad, F.lit("</div>"))
    pages = table(spark, sf_dir, "pages").filter(F.trim(F.translate(ad, "\n\t", "  ")) != "")
    shown = html.trees(pages, keep=("page_id",)).select("page_id", F.size("blocks").alias("n"))
    found = html.trees(pages.withColumn("html", F.replace("html", plain, F.concat(opened, ad, ended))), keep=("page_id",))
    both = found.filter(F.size("hidden") == 1).join(shown, "page_id")
    return both.select("page_id", F.sha2(F.col("hidden")[0], 256).alias("hidden"), (F.col("n") - F.size("blocks")).alias("blocks_less"))


@query("html_link_words", f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS ts FROM pages),
l AS (SELECT page_id, url, unnest(range(len(hs))) AS place, unnest(hs) AS h, unnest(ts) AS t FROM a)
SELECT page_id, place::INT AS place, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || {READ.format('h')} ELSE {READ.format('h')} END AS link, trim(regexp_replace({READ.format('t')}, '\\s+', ' ', 'g')) AS words FROM l""")
def html_link_words(spark, sf_dir):
    return html.links(trees(spark, sf_dir), "page_id").select("page_id", "place", "link", F.col("text").alias("words"))
