"""Signals of fields against a plain search phrase by phrase, states of fields, and acts to bring in."""

import random
import re

from pyspark.sql import functions as F

from attesta.operators import expansion as E
from attesta.operators import fields as C


def searched(text, phrases):
    """field -> (start, signal), by trying each phrase at each place."""
    out = {}
    plain = text.translate(str.maketrans("áéíóúÁÉÍÓÚ", "aeiouAEIOU")).lower()
    stand = {"~": "(?:os|as|o|a)", "^": "(?:an|a)", "##": r"\d{1,2}", "#": r"\d+", "*": r"\w+"}
    for field, told in phrases.items():
        for at in range(len(text)):
            if at and re.match(r"\w", plain[at - 1]):
                continue
            for p in told:
                words = [w for w in p.split(" ") if w != "/"]
                tried = r"\s+".join("(?:" + "|".join("".join(stand.get(x, re.escape(x)) for x in re.split(r"(##|[~^#*])", o)) for o in w.split("|")) + ")" for w in words)
                tried = tried.replace(r"(?:\d{1,2})\s+(?:\d{1,2})", r"\d{1,2}\s*/\s*\d{1,2}")
                if m := re.match(tried, plain[at:]):
                    out[field] = (at, text[at : at + m.end()])
                    break
            if field in out:
                break
    return out


def test_signals_are_those_of_each_phrase_alone(spark):
    rng = random.Random(7)
    parts = [w for told in C.SIGNALS.values() for p in told for w in re.sub("~", "as", re.sub(r"\^", "án", p)).replace("##", "31").replace("#", "18").replace("*", "diez").replace("|", " ").split(" ")]
    texts = [" ".join(rng.choice([*parts, "de", "a", "el", "𝄞", "Ñandú", "10 / 4"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["", "SALVO que", "insalvo", "plazo  de\n30", "hasta el 31/12", "hasta el 31 / 1", "hasta el 131/12", "Menores de 18 AÑOS", "serán beneficiarios", "x " * 2_000 + "salvoconducto"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.signals(F.col("t")).alias("s")).collect()
    assert {r.i: {s.field: (s.start, s.signal) for s in r.s} for r in got} == {i: searched(t, C.SIGNALS) for i, t in enumerate(texts)}




def test_candidates_quote_what_is_around_and_skip_other_acts(spark):
    rows = [(1, 1, "ENACTING", "é" * 100 + " excepto " + "b" * 300), (1, 2, "QUOTED", "excepto"), (1, 3, None, "excepto"), (2, 4, "ENACTING", None), (2, 5, "ENACTING", "")]
    got = C.candidates(spark.createDataFrame(rows, "version_id int, unit_id int, role string, text string")).collect()
    assert [(r.unit_id, r.field, r.signal, r.start) for r in got] == [(1, "keep", "excepto", 101)]
    assert got[0].fragment == "é" * 59 + " excepto " + "b" * 199


def test_units_are_searched_where_their_signals_are_made_and_nowhere_else(spark):
    units = spark.createDataFrame([(1, 1, "ENACTING", "salvo")], "version_id int, unit_id int, role string, text string")
    plan = C.candidates(units)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "salvo" in line and "Project" not in line]


def test_states_of_fields(spark):
    versions = spark.createDataFrame([(1,), (2,), (3,)], "version_id int")
    claims = [(1, "terms", "APPROVED", True), (1, "terms", "CANDIDATE", True), (1, "keep", "CANDIDATE", True), (1, "keep", "CANDIDATE", True), (2, "terms", "APPROVED", False), (2, "keep", "PUBLISHED", None), (2, "other", "APPROVED", True), (9, "keep", "APPROVED", True), (2, None, None, None)]
    found = C.states(versions, spark.createDataFrame(claims, "version_id int, field string, review string, informed boolean"))
    got = {(r.version_id, r.field): (r.state, r.n) for r in found.collect()}
    assert len(got) == 3 * len(C.FIELDS)
    assert {k: v for k, v in got.items() if v[0] != "NOT_INFORMED"} == {(1, "terms"): ("INFORMED", 1), (1, "keep"): ("PENDING", 2)}
    shares = {r.field: (r.evaluated, r.informed, r.pending, r.informed_share) for r in C.completeness(found).collect()}
    assert shares["terms"] == (3, 1, 0, 1 / 3) and shares["keep"] == (3, 0, 1, 0.0)
    assert C.states(versions.limit(0), spark.createDataFrame(claims, "version_id int, field string, review string, informed boolean")).count() == 0


def test_relations_count_on_both_sides(spark):
    rows = [(1, 2), (1, 3), (4, 4), (None, 1)]
    assert {r.version_id: r.n for r in C.interdependencies(spark.createDataFrame(rows, "from_id int, to_id int")).collect()} == {1: 3, 2: 1, 3: 1, 4: 2}


def test_acts_to_bring_in(spark):
    cited = [("ley", 1, 2000)] * 3 + [("ley", 1, None), ("ley", 2, 2000), ("ley", 3, 2000), ("ley", 4, 2000), ("ley", 5, 2000), ("ley", 6, 2000), ("ley", 7, 2000), (None, 1, 2000), ("ley", None, 2000)]
    held = [
        (1, "ley", 1, 2000, False, "http://h/1/norma.htm"), (1, "ley", 1, 2000, False, "http://h/1/texact.htm"), (3, "ley", 3, 2000, False, "http://h/3/norma.htm"), (33, "ley", 3, 2000, False, None),
        (4, "ley", 4, 2000, True, "http://h/4/norma.htm"), (5, "ley", 5, 2000, None, None), (5, "ley", 5, 2000, None, "http://h/5"), (6, "ley", 6, 2000, False, "https://h/6/norma.htm"), (7, "ley", 7, None, False, "http://h/7/norma.htm"),
    ]
    catalogue = spark.createDataFrame(held, "norm_id int, act string, number int, year int, uncertain boolean, url string")
    known = spark.createDataFrame([("https://h/6/norma.htm",), ("https://h/6/norma.htm",), (None,)], "url string")
    got = E.expansion(spark.createDataFrame(cited, "act string, number int, year int"), catalogue, known).collect()
    assert {(r.number, r.year): (r.cites, r.outcome, r.norm_id, r.url, r.form) for r in got} == {
        (1, 2000): (3, "ADD", 1, "https://h/1/texact.htm", "texact.htm"), (1, None): (1, "NO_YEAR", None, None, None), (2, 2000): (1, "NOT_FOUND", None, None, None),
        (3, 2000): (1, "AMBIGUOUS", None, None, None), (4, 2000): (1, "UNCERTAIN", 4, None, None), (5, 2000): (1, "NO_TEXT", 5, None, None),
        (6, 2000): (1, "PRESENT", 6, "https://h/6/norma.htm", "norma.htm"), (7, 2000): (1, "NOT_FOUND", None, None, None),
    }
