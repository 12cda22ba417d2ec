"""Roles of articles, routes, and references to annexes on fixtures."""

import re

import pytest

from attesta.operators import structure as S
from attesta.plans import registry
from attesta.plans import structure as plans

KINDS = "act long, place int, text string, quoted boolean"


def read(*paragraphs):
    act = S.Act()
    return [act.add(*(p if isinstance(p, tuple) else (p, False))) for p in paragraphs]


def roles(*paragraphs):
    return [(u["number"], u["role"], u["doubt"]) for u in read(*paragraphs) if u["kind"] == "ARTICLE"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ARTÍCULO 1°- Texto", ("ARTICLE", "1", None)), ("Art. 14 bis.- x", ("ARTICLE", "14", "bis")), ("artículo Nº 26: x", ("ARTICLE", "26", None)), ("ART 3 quáter", ("ARTICLE", "3", "quater")),
        ("TÍTULO IV De", ("TITLE", "IV", None)), ("Capítulo 2", ("CHAPTER", "2", None)), ("título de la obra", ("", None, None)), ("SECCIÓN III", ("SECTION", "III", None)), ("Libro I", ("BOOK", "I", None)),
        ("ANEXO", ("ANNEX", None, None)), ("Anexo II - x", ("ANNEX", "II", None)), ("Anexos varios", ("", None, None)), ("DISPOSICIONES TRANSITORIAS", ("TRANSITORY", None, None)), ("Transitoria", ("TRANSITORY", None, None)),
        ("VISTO: la ley", ("VISTO", None, None)), ("CONSIDERANDO que", ("CONSIDERANDO", None, None)), ("(Nota Infoleg: x)", ("EDITORIAL", None, None)), ("a) uno", ("ITEM", "a", None)), ("12. doce", ("ITEM", "12", None)),
        ("123. no", ("", None, None)), ("a)sin blanco", ("", None, None)), ("Artículos varios", ("", None, None)), ("", ("", None, None)), ("de acuerdo", ("", None, None)),
    ],
)
def test_markers(text, want):
    assert S.marker(text) == want


def test_three_roles_and_what_is_in_doubt():
    assert roles("Artículo 1.- a", "Artículo 2.- b", "Artículo 1.- c", "Artículo 3.- d") == [("1", "ENACTING", None), ("2", "ENACTING", None), ("1", "QUOTED", "NUMBERS_GO_BACK"), ("3", "ENACTING", None)]
    assert roles("Artículo 1.- Sustitúyese el artículo 10 de la Ley 5", "Artículo 10.- nuevo", "Artículo 2.- Rige") == [("1", "ENACTING", None), ("10", "SUBSTITUTED", None), ("2", "ENACTING", None)]
    # a block of several articles, then the body goes on
    assert [r[1] for r in roles("Artículo 4.- Incorpóranse los siguientes", ("«Artículo 20.- x»".strip("«»"), True), "Artículo 21.- y", "Artículo 5.- z")] == ["ENACTING", "SUBSTITUTED", "SUBSTITUTED", "ENACTING"]
    # 5 goes on with both the body (4) and the block (none yet is 5 - 1): only the body
    assert roles("Artículo 4.- Modifícase lo que sigue", "Artículo 5.- x")[1] == ("5", "ENACTING", None)
    assert roles("Artículo 4.- Reemplázase x", "Artículo 9.- x")[1] == ("9", "SUBSTITUTED", "BODY_OR_GIVEN_TEXT")
    assert roles("Artículo 4.- Déjanse redactados así", ("Artículo 4.- x", False), "Artículo 5.- y")[1:] == [("4", "SUBSTITUTED", None), ("5", "SUBSTITUTED", "BODY_OR_GIVEN_TEXT")]
    assert roles("Artículo 4.- x", "Artículo 4 bis.- y")[1] == ("4-bis", "ENACTING", None)
    assert roles("Artículo 1.- Sustitúyense los artículos 7, 8 y 9 bis", "Artículo 8.- a", "Artículo 9.- b", "Artículo 7.- c") == [("1", "ENACTING", None), *((k, "SUBSTITUTED", None) for k in "897")]


def test_an_annex_counts_anew_and_containers_close_each_other():
    units = read("Texto previo", "TÍTULO I", "CAPÍTULO I", "Artículo 1.- a", "a) uno", "sigue", "CAPÍTULO II", "suelto", "Artículo 2.- b", "TÍTULO II", "Artículo 3.- c", "ANEXO I", "Artículo 1.- d", "ANEXO", "ANEXO", "(Nota Infoleg: x)")
    assert [(u["kind"], u["route"], u["parent"]) for u in units] == [
        ("UNPLACED", None, None), ("TITLE", "title-I", None), ("CHAPTER", "title-I/chapter-I", 1), ("ARTICLE", "title-I/chapter-I/article-1", 2), ("ITEM", "title-I/chapter-I/article-1/item-a-4", 3),
        ("PARAGRAPH", "title-I/chapter-I/article-1/paragraph-5", 3), ("CHAPTER", "title-I/chapter-II", 1), ("UNPLACED", None, None), ("ARTICLE", "title-I/chapter-II/article-2", 6), ("TITLE", "title-II", None),
        ("ARTICLE", "title-II/article-3", 8), ("ANNEX", "annex-I", None), ("ARTICLE", "annex-I/article-1", 10), ("ANNEX", "annex-12", None), ("ANNEX", "annex-13", None), ("EDITORIAL", "editorial[note:14]", None),
    ]
    assert units[12]["role"] == "ENACTING" and units[12]["doubt"] is None
    given = read("Artículo 10.- Sustitúyese el artículo 10", "Artículo 10.- x", "b) y")
    assert [u["route"] for u in given] == ["article-10", "article-10/article-10[substituted:2]", "article-10/item-b-3"]


def test_acts_are_read_apart_in_order(spark):
    rows = [(2, 1, "Artículo 1.- a", None), (2, 0, "TÍTULO I", False), (1, 5, " ", True), (1, 6, None, None), (None, 1, "Artículo 2.- q", True), (None, 0, "Artículo 1.- Incorpórase", None), (1, 1, "Artículo 7.- z", False)]
    found = S.segmented(spark.createDataFrame(rows, KINDS).selectExpr("*", "'x' kind_", "1 number_"), "act").collect()
    got = {(r.act, r.place): (r.n, r.kind, r.role, r.number, r.parent, r.route, r.doubt) for r in found}
    assert got == {
        (2, 0): (1, "TITLE", "ENACTING", "I", None, "title-I", None), (2, 1): (2, "ARTICLE", "ENACTING", "1", 1, "title-I/article-1", None), (1, 1): (1, "ARTICLE", "ENACTING", "7", None, "article-7", None),
        (None, 0): (1, "ARTICLE", "ENACTING", "1", None, "article-1", None), (None, 1): (2, "ARTICLE", "SUBSTITUTED", "2", 1, "article-1/article-2[substituted:2]", None),
    }
    assert S.segmented(spark.createDataFrame([], KINDS), "act").collect() == []


def test_a_sentence_over_two_units_belongs_to_the_first(spark):
    units = [
        (1, 10, 1, "Visto lo actuado. Apruébase el Anexo (IF-2025-"), (1, 11, 2, "53544032-GCABA-SSGDA) el cual forma"), (1, 12, 3, "parte integrante de la presente. Rige el anexo"), (1, 13, 4, "que se aprueba. Nada"),
        (1, 14, 5, "Forma parte integrante el anexo"), (2, 20, 1, "El ANEXO I integra la presente"), (2, 21, 2, "El ANEXO I integra la presente."), (3, 30, 1, None), (3, 31, 2, "anexos. que se aprueba"),
    ]
    found = S.remissions(spark.createDataFrame(units, "doc int, id int, ord int, text string"), "doc", "id", "ord", "text")
    got = sorted(((r.doc, r.unit, r.offset, r.sentence, r.identifier) for r in found.collect()), key=str)
    assert got == [
        (1, 10, 17, "Apruébase el Anexo (IF-2025- 53544032-GCABA-SSGDA) el cual forma parte integrante de la presente", "IF-2025-53544032-GCABA-SSGDA"),
        (1, 12, 115, "Rige el anexo que se aprueba", None),
        (2, 20, 0, "El ANEXO I integra la presente El ANEXO I integra la presente", None),
    ]
    settled = spark.createDataFrame([(1, "Rige el anexo que se aprueba")], "doc int, sentence string")
    left = S.pending_annexes(found, settled, "doc")
    assert {(r.doc, r.unit) for r in left.collect()} == {(1, 10), (2, 20)}
    assert {tuple(r) for r in S.blocked_fields(left, "doc").collect()} == {(d, f, i) for d, i in ((1, "IF-2025-53544032-GCABA-SSGDA"), (2, "")) for f in S.ANNEX_FIELDS}


def test_heads_and_formulas_that_come_again_are_read_once():
    S.head_marker.cache_clear()
    S.short_tells.cache_clear()
    said = "Artículo 1.- Sustitúyese el artículo 10 de la Ley 5"
    assert [S.Act().add(said, False)["route"] for _ in range(3)] == ["article-1"] * 3
    assert (S.head_marker.cache_info().misses, S.short_tells.cache_info().misses) == (1, 1)
    long = "Artículo 2.- Modifícase" + " x" * S.SHORT
    assert S.tells_of(long) == (True, frozenset({2})) and S.short_tells.cache_info().misses == 1  # long texts aren't kept
    assert S.marker("Título IV" + " de" * 50) == ("TITLE", "IV", None)


@pytest.mark.parametrize("name", ["annex_remissions", "article_roles"])
def test_orders_are_dealt_by_their_count(spark, small, monkeypatch, name):
    """The tasks that put orders together get about TASK_ROWS line items each, however little these take in a shuffle."""
    monkeypatch.setattr(plans, "TASK_ROWS", 500, raising=False)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    plan = str(registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan())
    dealt = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert set(dealt) == {str(-(-rows // 500))} and rows > 5000
    summed = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "place" in x or "l_linenumber" in x]
    assert not summed
