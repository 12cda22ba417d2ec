"""Text structure and extraction: blocks of pages, lines joined again, units with routes, citations, date ranges, amounts, phones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.strings import full_year

# fixed values: names of the months as the sources write them, and the tags that end a block
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
BLOCK_TAGS = "p|div|li|ul|ol|table|tr|td|th|h[1-6]|br|section|article|blockquote|nav|title|head|body"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# fixed values: characters before a citation that tell its relation, and the digits that a phone number can have
LOOK_BACK = 140
PHONE_DIGITS = (8, 13)


def paragraphs(html: str) -> Column:
    """The visible blocks of a page in order, tags removed, entities read, white space joined, empty blocks left out."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<(script|style)[ >].*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"[ \t\r\n]+", " ")
    c = F.regexp_replace(c, rf"</?({BLOCK_TAGS})([ /][^>]*)?>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def links(html: str) -> Column:
    """The targets of a page's anchors in order."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))


def absolute(base: Column, target: Column) -> Column:
    """A target against its page's address: absolute ones stay, rooted ones take the host, others the folder; fragments go."""
    bare = F.regexp_replace(target, "#.*$", "")
    host = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^(https?://[^/]+(?:/.*)?/)", 1)
    return F.when(bare.rlike("^https?://"), bare).when(bare.startswith("/"), F.concat(host, bare)).otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), bare))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))


def joined_lines(rows: DataFrame, key: str) -> DataFrame:
    """key, block, first_place, n_lines, n_chars: a line goes on with the one before it if that one is open (no closing mark) and it begins in lower case."""
    w = Window.partitionBy(key).orderBy("place")
    before = F.lag("line").over(w)
    follows = ~before.rlike(r"[.:;!?]\s*$") & F.col("line").rlike(r"^\s*[a-z(]")
    marked = rows.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    block = marked.withColumn("block", F.sum("opens").over(w))
    return block.groupBy(key, "block").agg(F.min("place").alias("first_place"), F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def units(rows: DataFrame, key: str, levels: list[tuple[str, str]]) -> DataFrame:
    """rows (key, place, line) plus kind and route by markers, outermost level first, each (kind, pattern whose group 1 is the number).

    A marker opens a unit inside the open units of the outer levels and closes those of its own level and below. A line without a
    marker belongs to the open unit; lines before any marker have an empty route. A unit without a number takes its count in the document.
    """
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    kind = F.coalesce(*(F.when(F.col("line").rlike(p), name) for name, p in levels))
    out = out.withColumn("kind", kind)
    for i, (name, p) in enumerate(levels):
        here = F.col("kind") == name
        number = F.regexp_extract("line", p, 1)
        label = F.concat(F.lit(name + "-"), F.coalesce(F.nullif(F.lower(number), F.lit("")), F.count(F.when(here, 1)).over(w).cast("string")))
        out = out.withColumn(f"_l{i}", F.last(F.when(here, F.struct("place", label.alias("label"))), ignorenulls=True).over(w))
    parts, start = [], F.lit(-1)
    for i in range(len(levels)):
        open_ = F.col(f"_l{i}.place") >= start  # a marker of an outer level since then has closed this one
        parts.append(F.when(open_, F.col(f"_l{i}.label")))
        start = F.greatest(start, F.coalesce(F.col(f"_l{i}.place"), F.lit(-1)))
    return out.withColumn("route", F.concat_ws("/", *parts)).drop(*(f"_l{i}" for i in range(len(levels))))


def citations(rows: DataFrame, key: str, text: str, act: str, verbs: list[tuple[str, str]]) -> DataFrame:
    """key, act, number, year, relation of each citation. `act` is an alternation of act types; the relation is that of the first pattern of
    `verbs` that the LOOK_BACK characters before the citation (after the previous one) match, else CITES. Two-digit years above 40 are of 19xx."""
    pattern = rf"(?i)\b({act})\s+N?[°º.]*\s*(\d{{1,3}}(?:\.\d{{3}})+|\d+)(?:/(\d{{4}}|\d{{2}})\b)?"
    # what lies between citations is cut out by them, and the parts of each are read from it alone: a text is gone through twice, whatever its
    # length. An outer explode, as Spark infers for others a filter that reads the texts once more
    between = F.transform(F.split(text, pattern, -1), lambda t: F.right(t, F.lit(LOOK_BACK)))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    read = rows.select(key, F.zip_with(whole, between, lambda w, b: F.struct(w.alias("whole"), b.alias("before"))).alias("read"))
    cited = read.select(key, F.explode_outer("read").alias("w")).filter("w.whole is not null")
    field = lambda i: F.regexp_extract("w.whole", pattern, i)
    found = cited.select(key, F.struct(F.col("w.before").alias("before"), field(1).alias("act"), field(2).alias("number"), field(3).alias("year")).alias("c"))
    year = F.nullif(F.col("c.year"), F.lit("")).cast("int")
    relation = F.coalesce(*(F.when(F.col("c.before").rlike(p), name) for name, p in verbs), F.lit("CITES"))
    return found.select(key, F.lower("c.act").alias("act"), F.regexp_replace("c.number", r"\.", "").cast("long").alias("number"), F.when(year < 100, full_year(year)).otherwise(year).alias("year"), relation.alias("relation"))


def date_range(text: str, context_year: Column | None = None) -> Column:
    """struct(start, end, state) of "del D de M [de Y] al D de M [de Y]", also with "hasta el", "D°" and "del Y"; the state is GIVEN, DERIVED (a year was inferred) or PENDING
    (no range, no year at all, or a day that does not exist)."""
    side = r"(\d{1,2})[°º]?\s+(?:de\s+)?(" + "|".join(MONTHS) + r")(?:\s+(?:del?\s+)?(\d{4}))?"
    part = lambda i: F.nullif(F.regexp_extract(F.lower(text), rf"\bdel?\s+{side}\s+(?:al?|hasta\s+el)\s+{side}", i), F.lit(""))
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    d1, m1, y1, d2, m2, y2 = part(1).cast("int"), months[part(2)], part(3).cast("int"), part(4).cast("int"), months[part(5)], part(6).cast("int")
    context = F.lit(None).cast("int") if context_year is None else context_year
    start_year = F.coalesce(y1, y2, context)
    end_year = F.coalesce(y2, start_year + F.when((m2 < m1) | ((m2 == m1) & (d2 < d1)), 1).otherwise(0))
    day = lambda y, m, d: F.try_to_date(F.format_string("%d-%d-%d", y, m, d), "y-M-d")
    start, end = F.when(start_year.isNotNull(), day(start_year, m1, d1)), F.when(end_year.isNotNull(), day(end_year, m2, d2))
    pending = start.isNull() | end.isNull()
    return F.struct(F.when(~pending, start).alias("start"), F.when(~pending, end).alias("end"), F.when(pending, "PENDING").when(y1.isNull() | y2.isNull(), "DERIVED").otherwise("GIVEN").alias("state"))


def amounts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, since, place (from 0), amount of each amount on a line after its "a partir del d/m/Y"; amounts without a date, or with one that
    does not exist, are left out."""
    p = F.lit(r"(?i)a partir del (\d{1,2}/\d{1,2}/\d{4})([^\n]*)")
    both = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("day"), F.regexp_extract_all(text, p, F.lit(2)).alias("rest"))
    found = rows.select(key, F.explode(both).alias("a")).select(key, F.try_to_date("a.day", "d/M/y").alias("since"), F.col("a.rest").alias("rest"))
    each = found.filter("since is not null").select(key, "since", F.posexplode(F.regexp_extract_all("rest", F.lit(r"\$ ?([\d.]*\d(?:,\d{2})?)"), F.lit(1))).alias("place", "amount"))
    number = F.replace(F.replace(F.col("amount"), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return each.select(key, "since", "place", number.cast("decimal(18,2)").alias("amount"))


def phones(text: str) -> Column:
    """The phone numbers of a text as digits: groups with separators, 8 to 13 digits."""
    raw = F.regexp_extract_all(text, F.lit(r"[+]?[0-9]*[ ]?[(]?[0-9]{2,4}[)]?[ -][0-9]{3,4}[ -][0-9]{3,4}"), F.lit(0))
    digits = F.transform(raw, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda x: F.char_length(x).between(*PHONE_DIGITS)))
