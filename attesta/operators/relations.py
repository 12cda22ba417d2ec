"""From citations to relations between acts, and the date that an act's own text gives it."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.text import MONTHS

# fixed values: the participles by which a note tells that another act changed the text, and the kinds of acts that a note names
CHANGED_BY = ("sustituid", "incorporad", "modificad", "derogad", "observad", "reemplazad")
ACTS = ("decreto", "ley", "resolucion", "resolución", "disposicion", "disposición", "ordenanza")
#: Years that a date can have, and the length of the place in a heading.
YEARS, PLACE = range(1800, 2100), range(3, 62)
TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")


def resolved(cites: DataFrame, acts: DataFrame) -> DataFrame:
    """cites (act_id, jurisdiction, unit_id, act, number, year, relation), once each, with `target` and `candidates`.

    An act (act_id, jurisdiction, type, number, year, uncertain) is the target if it alone has the type, number and, where it is told, the
    year, within the jurisdiction; acts of uncertain identity never are. Candidates are how many have them.
    """
    # an act counts under its year and under none, so that one join serves the citations with and without a year. Acts
    # aren't broadcast: their columns repeat, so what they shuffle is small beside what they take in memory
    told = F.explode(F.array_distinct(F.array("year", F.lit(None).cast(acts.schema["year"].dataType))))
    sure = acts.filter("not uncertain").select("jurisdiction", F.col("type").alias("act"), "number", told.alias("year"), F.col("act_id").alias("found"))
    known = sure.groupBy("jurisdiction", "act", "number", "year").agg(F.count("*").alias("candidates"), F.min("found").alias("found"))
    names = ["act_id", "jurisdiction", "unit_id", "act", "number", "year", "relation"]
    once = cites.select(*names).distinct()
    same = [once[k] == known[k] for k in ("jurisdiction", "act", "number")]
    both = once.join(known.hint("merge"), [*same, once["year"].eqNullSafe(known["year"])], "left").select(*(once[n] for n in names), F.coalesce("candidates", F.lit(0)).alias("candidates"), "found")
    return both.withColumn("target", F.when(F.col("candidates") == 1, F.col("found"))).drop("found")


def relations(cites: DataFrame, passive: dict[str, str]) -> DataFrame:
    """from_id, to_id, relation, from_unit, to_unit of resolved citations, once each. A relation in `passive` is told by the act that it is
    done to: it turns round and takes the name given there. An act that names itself is left out."""
    linked = cites.filter(F.col("target") != F.col("act_id"))
    turned = F.col("relation").isin(*passive)
    name = F.coalesce(*(F.when(F.col("relation") == k, v) for k, v in passive.items()), F.col("relation"))
    return linked.select(
        F.when(turned, F.col("target")).otherwise(F.col("act_id")).alias("from_id"), F.when(turned, F.col("act_id")).otherwise(F.col("target")).alias("to_id"), name.alias("relation"),
        F.when(~turned, F.col("unit_id")).alias("from_unit"), F.when(turned, F.col("unit_id")).alias("to_unit"),
    ).distinct()


def pending(cites: DataFrame) -> DataFrame:
    """act_id, act, number, year, relation, candidates of the citations without a target, once for each act that cites."""
    return cites.filter("target is null").select("act_id", "act", "number", "year", "relation", "candidates").distinct()


class Scan:
    """The tokens of one text (digits, letters, other characters) with their places, and its outermost brackets, found in one pass each."""

    def __init__(self, text: str):
        found = [(m.group(), m.start()) for m in TOKEN.finditer(text)]
        self.text, self.words, self.starts = text, [w.lower() for w, _ in found], [i for _, i in found]
        self.notes: list[tuple[int, int]] = []  # first and last token of each outermost bracket that closes
        opened: list[int] = []
        for i, w in enumerate(self.words):
            if w == "(":
                opened.append(i)
            elif w == ")" and opened:
                first = opened.pop()
                while self.notes and self.notes[-1][0] > first:
                    self.notes.pop()  # it was inside this one
                self.notes.append((first, i))

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def number(self, i: int) -> int | None:
        w = self.word(i)
        return int(w) if len(w) <= 4 and w.isdigit() else None

    def days(self) -> Iterator[tuple[int, dt.date, bool]]:
        """Token, day and whether the text declares it as its own: d/m/yyyy, d de month de yyyy after a heading's place, and the formula
        "a los d días del mes de month de(l año) yyyy". A day that doesn't exist is none."""
        for i in range(len(self.words)):
            if self.number(i) is None or self.word(i + 1) not in ("/", "de", "días", "dias"):
                continue
            declared, year = False, None
            if self.word(i + 1) == "/" and self.word(i + 3) == "/":
                month, year = self.number(i + 2), self.number(i + 4)
            elif self.word(i + 1) == "de" and self.word(i + 3) == "de":
                month, year, declared = MONTHS.get(self.word(i + 2)), self.number(i + 4), self.follows_place(i)
            elif self.words[i + 2 : i + 5] == ["del", "mes", "de"] and self.words[max(0, i - 2) : i] == ["a", "los"]:
                month, declared = MONTHS.get(self.word(i + 5)), True
                year = self.number(i + 7) if self.word(i + 6) == "de" else self.number(i + 8) if self.word(i + 6) == "del" else None
            if year in YEARS and month:
                try:
                    yield i, dt.date(year, month, self.number(i)), declared
                except ValueError:
                    continue

    def follows_place(self, i: int) -> bool:
        """Whether the line up to a token is a place, begun by a letter, and one comma."""
        start = self.text.rfind("\n", 0, self.starts[i]) + 1
        place, comma, rest = self.text[start : self.starts[i]].lstrip().partition(",")
        return bool(comma) and not rest.strip() and len(place) in PLACE and place[0].isalpha()

    def act(self, first: int, last: int) -> str | None:
        """The first act between two tokens that has a kind, a number and a year, as "Kind number/year"."""
        for i in range(first, last):
            if self.words[i] in ACTS:
                k = i + 1
                k += self.word(k) == "n"
                k += self.word(k) in ("°", "º")
                number = ""
                while self.word(k).isdigit() or (number and self.word(k) == "."):
                    number, k = number + self.word(k), k + 1
                year = self.word(k + 1)
                if number and self.word(k) == "/" and year.isdigit() and 2 <= len(year) <= 4:
                    return f"{self.words[i].capitalize()} {number}/{year}"
        return None


def read_date(text: str | None) -> tuple[dt.date | None, str, list[str]]:
    """date, state and acts of document_date() for one whole text."""
    if not (text or "").strip():
        return None, "NO_TEXT", []
    scan = Scan(text)
    changes = [(a, b) for a, b in scan.notes if any(w.startswith(CHANGED_BY) for w in scan.words[a:b])]
    own, loose, acts, at = set(), False, {}, 0
    for i, day, declared in scan.days():
        while at < len(changes) and changes[at][1] < i:
            at += 1
        if at < len(changes) and changes[at][0] < i:
            acts[scan.act(*changes[at]) or "UNIDENTIFIED"] = None
        else:
            loose = True
            if declared:
                own.add(day)
    state = "GIVEN" if len(own) == 1 else "SEVERAL" if own else "OTHER_ACTS" if acts else "LOOSE" if loose else "NO_DATE"
    return own.pop() if state == "GIVEN" else None, state, list(acts)


def read_dates(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_date(t) for t in texts], columns=["date", "state", "acts"])


def document_date(text: Column) -> Column:
    """struct(date, state, acts): the date that a heading ("Place, 3 de mayo de 2001") or the formula of sanction gives the document.

    A date within an outermost bracket that tells of a change is that of another act, which `acts` names. The state is GIVEN, or SEVERAL
    (own dates that differ), OTHER_ACTS (dates in notes only), LOOSE (dates that nothing explains), NO_DATE or NO_TEXT (null or blank); the
    date is null then. A text is read once from end to end, whatever its length and brackets.
    """
    return F.pandas_udf(read_dates, "date date, state string, acts array<string>")(text)
