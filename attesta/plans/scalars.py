"""Scalar functions, JSON, capture outcomes, calendars, sources of claims and walks to a root, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import strings as S
from attesta.plans.registry import query
from attesta.sources.tables import table

FOLD = f"translate({{}}, '{S.MARKED}', '{S.PLAIN}')"
KEY = f"trim(regexp_replace(regexp_replace(translate({FOLD}, '{S.UPPER}', '{S.LOWER}'), '[.]', '', 'g'), '[^a-z]+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return KEY.format(x)


@query("accent_fold", f"SELECT doc_id, sha256({FOLD.format('text')}) AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.fold(F.col("text")), 256).alias("folded"))


@query("comparable_key", f"SELECT doc_id, sha256({key_sql('text')}) AS key FROM documents")
def comparable_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.comparable_key(F.col("text")), 256).alias("key"))


@query(
    "slug",
    f"""SELECT doc_id, substr(regexp_replace(regexp_replace(translate({FOLD.format('text')}, '{S.LOWER}', '{S.UPPER}'), ' +', '-', 'g'), '[^A-Z0-9_.-]', '', 'g'), 1, 80) AS slug
FROM documents""",
)
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


ADDRESS_SQL = """'Av. ' || n_name || ' Calle Núñez ' || (s_suppkey * 37 % 9000 + 10) || CASE WHEN s_suppkey % 3 = 0 THEN ', Piso ' || (s_suppkey % 9 + 1) ELSE '' END"""


def addresses(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    floor = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat(', Piso ', s_suppkey % 9 + 1) ELSE '' END")
    return s.select("s_suppkey", "s_nationkey", F.concat(F.lit("Av. "), "n_name", F.lit(" Calle Núñez "), F.expr("s_suppkey * 37 % 9000 + 10"), floor).alias("address"))


@query(
    "address_parse",
    f"""WITH a AS (SELECT s_suppkey, {ADDRESS_SQL} AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, regexp_replace(address, '(?i) *,? *piso +[0-9]+.*$', '') AS rest, nullif(regexp_extract(address, '(?i)piso +([0-9]+)', 1), '')::INT AS floor FROM a),
h AS (SELECT *, regexp_extract_all(rest, '\\b([0-9]{{2,5}})\\b', 1) AS ns FROM r),
p AS (SELECT *, CASE WHEN len(ns) > 0 THEN ns[-1] END AS height, CASE WHEN len(ns) > 0 THEN trim(rest[1:position(ns[-1] IN rest) - 1]) ELSE trim(rest) END AS street FROM h)
SELECT s_suppkey, street, height::INT AS height, floor, array_to_string(list_sort(list_filter(string_split({key_sql('street')}, ' '), lambda w: w <> '' AND w NOT IN {S.STREET_KINDS})), ' ') AS street_key FROM p""",
)
def address_parse(spark, sf_dir):
    parsed = addresses(spark, sf_dir).select("s_suppkey", S.address(F.col("address")).alias("p"))
    return parsed.select("s_suppkey", "p.street", "p.height", "p.floor", S.street_key(F.col("p.street")).alias("street_key"))


NAMES_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'Provincia de ' || c_name WHEN 1 THEN 'MUNICIPALIDAD de ' || c_name WHEN 2 THEN 'Municipio, Provincia de ' || c_name ELSE 'Oficina ' || c_name END"


@query(
    "territorial_scope",
    f"""WITH n AS (SELECT c_custkey, ' ' || {key_sql('(' + NAMES_SQL + ')')} || ' ' AS k FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(k, ' (municipalidad|municipal|municipio) ') THEN 'MUNICIPAL' WHEN regexp_matches(k, ' (provincia|provincial) ') THEN 'PROVINCIAL' ELSE 'NO_DECLARADO' END AS scope FROM n""",
)
def territorial_scope(spark, sf_dir):
    name = F.expr(NAMES_SQL)
    return table(spark, sf_dir, "customer").select("c_custkey", S.territorial_scope(name).alias("scope"))


POINT_SQL = "'POINT(' || (-80 + s_suppkey % 40) || '.5 ' || (-60 + s_suppkey * 7 % 50) || '.25)'"


@query(
    "wkt_points",
    f"""WITH p AS (SELECT s_suppkey, regexp_extract({POINT_SQL}, '\\((\\S+)', 1)::DOUBLE AS x, regexp_extract({POINT_SQL}, ' (\\S+)\\)', 1)::DOUBLE AS y FROM supplier)
SELECT s_suppkey, CASE WHEN x BETWEEN -74 AND -53 AND y BETWEEN -55 AND -21 THEN x END AS x, CASE WHEN x BETWEEN -74 AND -53 AND y BETWEEN -55 AND -21 THEN y END AS y FROM p""",
)
def wkt_points(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").select("s_suppkey", S.wkt_point(F.expr(POINT_SQL), -74, -53, -55, -21).alias("p"))
    return found.select("s_suppkey", "p.x", "p.y")


@query(
    "digit_transposition",
    """WITH d AS (SELECT o_orderkey, o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 9)::VARCHAR ELSE reverse(o_orderkey::VARCHAR) END AS b FROM orders)
SELECT o_orderkey, a <> b AND list_sort(string_split(a, '')) = list_sort(string_split(b, '')) AS swapped FROM d""",
)
def digit_transposition(spark, sf_dir):
    a = F.col("o_orderkey").cast("string")
    b = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") + 9).cast("string")).otherwise(F.reverse(a))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.transposed(a, b).alias("swapped"))


@query(
    "two_digit_years",
    "SELECT p_partkey, CASE WHEN p_partkey % 100 > 40 THEN p_partkey % 100 + 1900 ELSE p_partkey % 100 + 2000 END AS full_year FROM part",
)
def two_digit_years(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.full_year(F.col("p_partkey") % 100).alias("full_year"))


WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in S.NUMBER_WORDS) + "]"
TERM_SQL = f"CASE WHEN p_size <= 20 AND p_partkey % 2 = 0 THEN 'plazo de ' || {WORDS_SQL}[p_size + 1] || ' días' ELSE 'plazo de ' || p_size || ' días' END"


@query(
    "term_support",
    f"""WITH t AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS n, ' ' || regexp_replace({FOLD.format('(' + TERM_SQL + ')')}, '[^a-z0-9]+', ' ', 'g') || ' ' AS said FROM part)
SELECT p_partkey, n, contains(said, ' ' || n || ' ') OR coalesce(contains(said, ' ' || CASE WHEN n <= 20 THEN {WORDS_SQL}[n + 1] END || ' '), false) AS supported FROM t""",
)
def term_support(spark, sf_dir):
    """Whether a term's quantity is in its citation, in digits or in words."""
    words = F.array(*map(F.lit, S.NUMBER_WORDS))
    in_words = (F.col("p_size") <= 20) & (F.col("p_partkey") % 2 == 0)
    said = F.concat(F.lit("plazo de "), F.when(in_words, F.get(words, F.col("p_size"))).otherwise(F.col("p_size").cast("string")), F.lit(" días"))
    n = F.expr("p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END")
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), S.supports(said, n).alias("supported"))


@query("page_keys", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]+', ''), '/$', '') AS page_key FROM pages")
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.page_key(F.col("url")).alias("page_key"))


@query("json_path", "SELECT event_type, count(*) AS n, sum((props::JSON->>'$.k')::BIGINT) AS total, count(*) FILTER (props::JSON->>'$.missing' IS NULL) AS without FROM events GROUP BY event_type")
def json_path(spark, sf_dir):
    value = F.get_json_object("props", "$.k").cast("long")
    without = F.count_if(F.get_json_object("props", "$.missing").isNull())
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total"), without.alias("without"))


@query("json_records", "SELECT o_orderkey, i::INT AS place, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS name, (o_custkey + i)::BIGINT AS number FROM orders, range(2) r(i)")
def json_records(spark, sf_dir):
    """Rows out of a JSON list of records."""
    blob = F.to_json(F.array(
        F.struct(F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("number")), F.struct(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") + 1).alias("number")),
    ))
    read = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(blob, "array<struct<name:string,number:long>>").alias("r"))
    return read.select("o_orderkey", F.posexplode("r").alias("place", "x")).select("o_orderkey", "place", "x.name", "x.number")


CAPTURES_SQL = """c AS (SELECT o_orderkey AS capture_id, o_custkey AS url_id, o_orderdate AS captured_at, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE [200, 304, 404, 200, 410, 429, 500, 200][o_orderkey % 8 + 1] END AS status,
 CASE WHEN o_orderkey % 8 IN (0, 3, 7) AND o_orderkey % 17 <> 0 THEN 'body' || o_orderkey END AS body FROM orders)"""


def captures(spark, sf_dir):
    """Captures of pages: capture_id, url_id, captured_at, status (null: the connection failed) and body."""
    failed = F.col("o_orderkey") % 17 == 0
    code = F.array(*map(F.lit, (200, 304, 404, 200, 410, 429, 500, 200)))
    place = (F.col("o_orderkey") % 8).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("url_id"), F.col("o_orderdate").alias("captured_at"),
        F.when(~failed, F.get(code, place)).alias("status"), F.when(place.isin(0, 3, 7) & ~failed, F.concat(F.lit("body"), "o_orderkey")).alias("body"),
    )


@query(
    "capture_outcomes",
    f"""WITH {CAPTURES_SQL} SELECT capture_id, CASE WHEN status IS NULL THEN 'ERROR_TLS' WHEN status = 429 THEN 'ACCESO_LIMITADO' WHEN status IN (404, 410) THEN 'NO_ENCONTRADA'
 WHEN status = 304 AND before IS NOT NULL THEN 'REUTILIZADA' WHEN status = 200 THEN 'CAPTURADA' ELSE 'NO_VERIFICADO' END AS outcome, CASE WHEN status = 304 THEN before ELSE body END AS body
FROM (SELECT *, last_value(body IGNORE NULLS) OVER (PARTITION BY url_id ORDER BY captured_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)""",
)
def capture_outcomes(spark, sf_dir):
    """Outcome of each capture; one that says "not changed" takes the last body of its page, if there is one."""
    earlier = Window.partitionBy("url_id").orderBy("captured_at", "capture_id").rowsBetween(Window.unboundedPreceding, -1)
    c = captures(spark, sf_dir).withColumn("before", F.last("body", ignorenulls=True).over(earlier))
    s = F.col("status")
    outcome = (
        F.when(s.isNull(), "ERROR_TLS").when(s == 429, "ACCESO_LIMITADO").when(s.isin(404, 410), "NO_ENCONTRADA")
        .when((s == 304) & F.col("before").isNotNull(), "REUTILIZADA").when(s == 200, "CAPTURADA").otherwise("NO_VERIFICADO")
    )
    return c.select("capture_id", outcome.alias("outcome"), F.when(s == 304, F.col("before")).otherwise(F.col("body")).alias("body"))


@query("previous_body", f"WITH {CAPTURES_SQL} SELECT url_id, arg_max(capture_id, (captured_at, capture_id)) AS capture_id FROM c WHERE status <> 304 AND body IS NOT NULL GROUP BY url_id")
def previous_body(spark, sf_dir):
    """The last capture with a body of its own for each page."""
    own = captures(spark, sf_dir).filter("status <> 304 AND body IS NOT NULL")
    return own.groupBy("url_id").agg(F.max_by("capture_id", F.struct("captured_at", "capture_id")).alias("capture_id"))


@query(
    "calendar_pick",
    """WITH k AS (SELECT s_suppkey AS calendar_id, s_nationkey AS place, DATE '1992-01-01' + (s_suppkey * 53 % 1500)::INT AS first_day, DATE '1994-01-01' + (s_suppkey * 91 % 1800)::INT AS last_day FROM supplier),
c AS (SELECT n_nationkey, DATE '1995-06-01' + (n_nationkey * 20)::INT AS day FROM nation)
SELECT n_nationkey, arg_max(calendar_id, (first_day, calendar_id)) AS calendar_id FROM c LEFT JOIN k ON place = n_nationkey AND day BETWEEN first_day AND last_day GROUP BY n_nationkey""",
)
def calendar_pick(spark, sf_dir):
    """The latest calendar of each place that covers its day; none: null."""
    k = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey calendar_id", "s_nationkey place", "date_add(DATE'1992-01-01', cast(s_suppkey * 53 % 1500 as int)) first_day", "date_add(DATE'1994-01-01', cast(s_suppkey * 91 % 1800 as int)) last_day"
    )
    c = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "date_add(DATE'1995-06-01', n_nationkey * 20) day")
    found = c.join(k, F.expr("place = n_nationkey AND day BETWEEN first_day AND last_day"), "left")
    return found.groupBy("n_nationkey").agg(F.max_by("calendar_id", F.when(F.col("calendar_id").isNotNull(), F.struct("first_day", "calendar_id"))).alias("calendar_id"))


@query(
    "attribution",
    """WITH a AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS official, bool_or(l_returnflag = 'N') AS secondary FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN official THEN 'OFFICIAL' WHEN secondary THEN 'SECONDARY' ELSE 'ABSTAIN' END AS attributed FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
)
def attribution(spark, sf_dir):
    """An official source wins, a secondary one is never the agency's, and without either the claim isn't attributed."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("official"), F.bool_or(F.col("l_returnflag") == "N").alias("secondary"))
    found = table(spark, sf_dir, "orders").join(flags, F.expr("l_orderkey = o_orderkey"), "left")
    return found.select("o_orderkey", F.when(F.col("official"), "OFFICIAL").when(F.col("secondary"), "SECONDARY").otherwise("ABSTAIN").alias("attributed"))


ALIASES_SQL = "s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey > 0 THEN s_suppkey // 2 WHEN s_suppkey % 31 = 5 THEN s_suppkey END AS alias_of FROM supplier)"


def aliases(spark, sf_dir):
    """Sources and what they are an alias of, some of themselves."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "CASE WHEN s_suppkey % 4 = 0 AND s_suppkey > 0 THEN s_suppkey div 2 WHEN s_suppkey % 31 = 5 THEN s_suppkey END alias_of")


@query("alias_resolution", f"WITH {ALIASES_SQL} SELECT l_suppkey AS source_id, coalesce(alias_of, id) AS canonical, count(*) AS n FROM lineitem JOIN s ON id = l_suppkey GROUP BY 1, 2")
def alias_resolution(spark, sf_dir):
    """Rows by the canonical source of their source, one step away. Rows are counted before the join."""
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).count()
    return each.join(aliases(spark, sf_dir), "id").select(F.col("id").alias("source_id"), F.coalesce("alias_of", "id").alias("canonical"), F.col("count").alias("n"))


@query(
    "alias_cycles",
    f"""WITH RECURSIVE {ALIASES_SQL}, w AS (SELECT id, alias_of AS at, 1 AS depth FROM s WHERE alias_of IS NOT NULL
 UNION ALL SELECT w.id, s.alias_of, depth + 1 FROM w JOIN s ON s.id = w.at WHERE s.alias_of IS NOT NULL AND depth < 16)
SELECT DISTINCT id FROM w WHERE depth = 16""",
)
def alias_cycles(spark, sf_dir):
    """Sources whose chain of aliases doesn't end within 16 steps: doubling the steps of all chains takes four joins."""
    step = aliases(spark, sf_dir).filter("alias_of IS NOT NULL").select("id", F.col("alias_of").alias("at"))
    for _ in range(4):
        step = step.select("id", "at").join(step.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at"))
    return step.select("id").distinct()
