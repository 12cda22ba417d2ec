"""The structure of acts: units with the role of each article, and sentences that refer to annexes, placed back in their units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words that open units, with the level of those that hold others; suffixes of articles; what tells that an article gives
# the text of another one; what an approved annex is named and referred to by
CONTAINERS = {"libro": ("BOOK", 1), "titulo": ("TITLE", 2), "capitulo": ("CHAPTER", 3), "seccion": ("SECTION", 4), "anexo": ("ANNEX", 1)}
ARTICLE_WORDS = ("articulo", "art")
SUFFIXES = ("bis", "ter", "quater", "quinquies", "sexies", "septies", "octies", "nonies", "decies")
REPLACING = frozenset(stem + end for stem in ("sustituy", "reemplaz", "incorpor", "modific") for end in ("ase", "ese", "anse", "ense"))
REWORDING, REWORDED = frozenset(("dejase", "dejese", "dejanse", "dejense")), "redactad"
ANNEX_PHRASES = (r"forman?\s+parte\s+integrante", r"integran?\s+la\s+presente", r"se\s+aprueban?", "aprobar", r"que\s+como\s+anexo")
ANNEX_ID = r"\b(?:IF|PLIEG|PV|DI|RESOL)-\s*\d{4}-\s*\d+-\s*[A-Z]+-\s*[A-Z]+\b"
ANNEX_FIELDS = ("terms", "applicability")
ROMAN = frozenset("ivxlcdm")
WORD = re.compile(r"\d+|[^\W\d_]+|[^\s\w]")
ITEM = re.compile(r"([a-z]|\d{1,2})\s*[).]\s")
#: Characters of a paragraph that its marker can take.
HEAD = 80
ENACTING, QUOTED, SUBSTITUTED, NOTE = "ENACTING", "QUOTED", "SUBSTITUTED", "NOTE"


#: Heads of paragraphs, and short texts of articles, whose reading a task remembers: most marks, and many formulas, come again.
REMEMBERED = 1 << 14
SHORT = 200
ORDINALS = {ord(c): " " for c in "°ºª"}


def folded(text: str) -> str:
    """Lower case without marks; signs of ordinals are blanks."""
    if text.isascii():
        return text.lower()
    bare = "".join([c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)])
    return bare.translate(ORDINALS).lower()


def is_number(word: str) -> bool:
    return word.isdigit() or bool(word) and ROMAN.issuperset(word)


def marker(text: str) -> tuple[str, str | None, str | None]:
    """Kind, number and suffix that the beginning of a paragraph marks; the kind is empty if it marks none."""
    return head_marker(text[:HEAD])


@lru_cache(REMEMBERED)
def head_marker(text: str) -> tuple[str, str | None, str | None]:
    head = folded(text).lstrip()
    words = WORD.findall(head)
    if words[:1] == ["("]:
        return ("EDITORIAL", None, None) if words[1:3] == ["nota", "infoleg"] else ("", None, None)
    first, rest = (words[0], words[1:]) if words else ("", [])
    if first == "nota" and rest[:1] == ["infoleg"]:
        return "EDITORIAL", None, None
    if first in CONTAINERS and first != "anexo" and rest and is_number(rest[0]):
        said = text.split(None, 2)[1:2] or rest
        return CONTAINERS[first][0], said[0][: len(rest[0])], None
    if first == "anexo" or (first.startswith("anexo") and is_number(first[5:])):
        number = first[5:] or (rest[0] if rest and is_number(rest[0]) else "")
        return "ANNEX", number.upper() or None, None
    if first in ("disposicion", "disposiciones"):
        first = rest[0] if rest else ""
        if first.rstrip("s") in ("transitoria", "complementaria"):
            return "TRANSITORY", None, None
    elif first.rstrip("s") in ("transitoria", "complementaria"):
        return "TRANSITORY", None, None
    if first in ("visto", "considerando"):
        return first.upper(), None, None
    if words and words[0] in ARTICLE_WORDS:
        rest = rest[1:] if rest[:1] == ["."] else rest
        rest = rest[1:] if rest[:1] == ["n"] else rest
        rest = rest[1:] if rest[:1] == ["."] else rest
        if rest and rest[0].isdigit():
            return "ARTICLE", rest[0], rest[1] if len(rest) > 1 and rest[1] in SUFFIXES else None
    if m := ITEM.match(head):
        return "ITEM", m[1], None
    return "", None, None


def tells_of(text: str) -> tuple[bool, frozenset[int]]:
    """Whether an article says that it gives another text, and the numbers of the articles that it names."""
    return short_tells(text) if len(text) <= SHORT else read_tells(text)


def read_tells(text: str) -> tuple[bool, frozenset[int]]:
    words = WORD.findall(folded(text))
    gives = any(w in REPLACING or (w in REWORDING and words[i + 1 : i + 2] and words[i + 1].startswith(REWORDED)) for i, w in enumerate(words))
    named, listing = set(), False
    for w in words:
        if w in ("articulo", "articulos", "art", "arts"):
            listing = True
        elif listing and w.isdigit():
            named.add(int(w))
        elif w not in SUFFIXES and w not in (",", "y", "e", "."):
            listing = False
    return gives, frozenset(named)


short_tells = lru_cache(REMEMBERED)(read_tells)


class Act:
    """One act read paragraph by paragraph. What is held is what is open: containers, the article, and the numbers reached; so an act may be
    of any length."""

    def __init__(self) -> None:
        self.n = 0
        self.containers: list[tuple[int, int, str]] = []  # level, unit, route
        self.article: tuple[int, str] | None = None  # unit and route
        self.gives, self.named = False, frozenset()
        self.body: int | None = None  # the last number of an article of the act's own
        self.given: int | None = None  # the last number of a text that the open article gives

    def role(self, number: int, suffix: str | None, quoted: bool) -> tuple[str, str | None]:
        """Whether an article's mark opens an article of this act or belongs to a text that the open article gives; and what is in doubt."""
        if self.article is None:
            return ENACTING, None
        back = self.body is not None and number <= self.body
        goes_on, block_goes_on = (last is not None and number == last + 1 for last in (self.body, self.given))
        if not self.gives:
            return (QUOTED, "NUMBERS_GO_BACK") if back and suffix is None else (ENACTING, None)
        if number in self.named or quoted or back:
            return SUBSTITUTED, None
        if goes_on != block_goes_on:
            return (ENACTING if goes_on else SUBSTITUTED), None
        return SUBSTITUTED, "BODY_OR_GIVEN_TEXT"

    def add(self, text: str, quoted: bool) -> dict:
        """The unit of a paragraph: n, kind, role, number, parent, route, doubt. Before the first article, what marks nothing is UNPLACED."""
        kind, number, suffix = marker(text)
        role, doubt, parent = ENACTING, None, None
        if kind == "EDITORIAL":
            role = NOTE
        elif kind == "ARTICLE":
            role, doubt = self.role(int(number), suffix, quoted)
            inner = self.containers[-1][1:] if self.containers else None
            parent = inner if role == ENACTING else self.article
        elif kind in ("", "ITEM"):
            if self.article is None:
                return {"n": None, "kind": "UNPLACED", "role": None, "number": None, "parent": None, "route": None, "doubt": None}
            kind, number, parent = kind or "PARAGRAPH", number if kind else None, self.article
        elif kind in LEVELS:
            while self.containers and self.containers[-1][0] >= LEVELS[kind]:
                self.containers.pop()
            parent = self.containers[-1][1:] if self.containers else None
        self.n += 1
        whole = f"{number}-{suffix}" if suffix else number
        label = kind.lower() + (f"-{whole}" if whole else "")
        if role != ENACTING:
            label += f"[{role.lower()}:{self.n}]"
        elif kind in ("PARAGRAPH", "ITEM") or not whole:
            label += f"-{self.n}"
        route = f"{parent[1]}/{label}" if parent else label
        if kind in LEVELS:
            self.containers.append((LEVELS[kind], self.n, route))
            self.article = None
            if kind == "ANNEX":
                self.body = self.given = None
        elif kind == "TRANSITORY" or (kind == "ARTICLE" and role == ENACTING):
            self.article = (self.n, route)
            self.gives, self.named = tells_of(text)
            if kind == "ARTICLE":
                self.body, self.given = int(number), None
        elif kind == "ARTICLE":
            self.given = int(number)
        return {"n": self.n, "kind": kind, "role": role, "number": whole, "parent": parent and parent[0], "route": route, "doubt": doubt}


LEVELS = {kind: level for kind, level in CONTAINERS.values()}
UNIT = "n int, kind string, role string, number string, parent int, route string, doubt string"
UNITS = [tuple(c.split()) for c in UNIT.split(", ")]
INT, STRING = pa.int32(), pa.string()


def segmented(paragraphs: DataFrame, key: str, place: str = "place", text: str = "text", quoted: str = "quoted") -> DataFrame:
    """paragraphs with the unit that each is: n (its number in the act), kind, role, number, parent (an n), route and doubt.

    An article opens an article of the act (ENACTING) or is one that the open article quotes or gives as another act's new text (QUOTED,
    SUBSTITUTED); doubt says why one can't be told. A container (book, title, chapter, section, annex) closes those of its level and
    below and the open article; an annex counts its articles anew. Acts are sorted by key and place and streamed, so a long one takes time in
    one task but no memory. Blank and null texts are left out, null keys are one act, equal places come in order of their texts.
    """
    rows = paragraphs.filter(F.trim(F.regexp_replace(text, r"\s", " ")) != "")
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, place, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act, open_key = Act(), object()
        for batch in batches:
            found = []
            for k, t, q in zip(*(batch.column(c).to_pylist() for c in (key, text, quoted)), strict=True):
                if k != open_key:
                    act, open_key = Act(), k
                found.append(act.add(t.strip(), q is True))
            units = [pa.array([u[n] for u in found], INT if kind == "int" else STRING) for n, kind in UNITS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *units], names=[*batch.schema.names, *(n for n, _ in UNITS)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paragraphs.schema.fields)
    return ordered.mapInArrow(run, f"{kept}, {UNIT}")


def remissions(units: DataFrame, doc: str, unit: str, order: str, text: str) -> DataFrame:
    """doc, unit, offset, sentence, identifier of each sentence of a document that refers to an annex which is part of it.

    A sentence may go over units, so they are read as one text, joined by line feeds; the unit is that in which the sentence begins, found
    among the units' starts by one running maximum over both, without pairs. A document's text is one row. Null texts are empty.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    w = Window.partitionBy(doc).orderBy(order, unit)
    starts = units.select(doc, (F.sum(F.char_length(said) + 1).over(w) - F.char_length(said) - 1).alias("offset"), F.col(unit).alias("unit"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(unit).alias("u"), said.alias("t"))))
    whole = units.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("whole"))
    pieces = whole.select(doc, F.posexplode(F.split("whole", "[.]")).alias("i", "piece"))
    at = F.sum(F.char_length("piece") + 1).over(Window.partitionBy(doc).orderBy("i")) - F.char_length("piece") - 1
    refers = rf"(?is)\banexos?\b.*\b(?:{'|'.join(ANNEX_PHRASES)})\b"
    sentence = F.trim(F.regexp_replace("piece", r"\s+", " "))
    found = pieces.select(doc, at.alias("offset"), "piece").filter(F.col("piece").rlike(refers)).select(doc, "offset", sentence.alias("sentence"))
    both = starts.withColumn("sentence", F.lit(None).cast("string")).unionByName(found.withColumn("unit", F.lit(None).cast(starts.schema["unit"].dataType)))
    inside = F.last("unit", ignorenulls=True).over(Window.partitionBy(doc).orderBy("offset", F.col("sentence").isNotNull()))
    named = F.nullif(F.regexp_replace(F.regexp_extract("sentence", f"({ANNEX_ID})", 1), r"\s+", ""), F.lit(""))
    return both.withColumn("unit", inside).filter("sentence is not null").select(doc, "unit", "offset", "sentence", named.alias("identifier"))


def pending_annexes(found: DataFrame, settled: DataFrame, doc: str) -> DataFrame:
    """doc, sentence, unit, identifier of the sentences that refer to an annex and aren't settled (doc, sentence), once each: of a repeated
    one the first place counts."""
    left = found.join(settled.select(doc, "sentence"), [doc, "sentence"], "left_anti")
    return left.groupBy(doc, "sentence").agg(F.min_by(F.struct("unit", "identifier"), "offset").alias("f")).select(doc, "sentence", "f.unit", "f.identifier")


def blocked_fields(pending: DataFrame, doc: str) -> DataFrame:
    """doc, field, identifiers: the fields that an annex would tell and that can't be told while it is missing."""
    names = pending.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set("identifier")), ", ").alias("identifiers"))
    return names.select(doc, F.explode(F.array(*map(F.lit, ANNEX_FIELDS))).alias("field"), "identifiers")
