"""Text operators on small fixtures whose shapes the driver's tables lack."""

from attesta.operators import text

VERBS = [("REPEALED_BY", r"(?i)derogad[ao] por"), ("REPEALS", r"(?i)der[oó]g[aue]+s?e?\b"), ("AMENDS", r"(?i)modif[ií][cq]\w+")]


def test_citations_take_their_relation_from_what_stands_before(spark):
    rows = spark.createDataFrame([(1, "Modifícase la Ley N° 1.234/98. Visto el Decreto 77/2010 y derogado por Ley 5000"), (2, "nada"), (3, None)], "id int, t string")
    found = {tuple(r)[1:] for r in text.citations(rows, "id", "t", "ley|decreto", VERBS).collect()}
    assert found == {("ley", 1234, 1998, "AMENDS"), ("decreto", 77, 2010, "CITES"), ("ley", 5000, None, "REPEALED_BY")}


def test_texts_are_gone_through_once_for_citations(spark):
    rows = spark.createDataFrame([(1, "Ley 5/98x, derogado por" + " y" * 50 + " ley 1.2345 Ley 7/19985" + "." * 200 + "LEY N° 8"), (2, "")], "id int, t string")
    found = text.citations(rows, "id", "t", "ley", VERBS)
    assert [tuple(r) for r in found.collect()] == [(1, "ley", 5, None, "CITES"), (1, "ley", 1234, None, "REPEALED_BY"), (1, "ley", 7, None, "CITES"), (1, "ley", 8, None, "CITES")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_two_digit_years_of_citations(spark):
    rows = spark.createDataFrame([(y, f"Ley 500/{y}") for y in (30, 40, 41)], "id int, t string")
    assert {tuple(r)[:1] + (r.year,) for r in text.citations(rows, "id", "t", "ley", VERBS).collect()} == {(30, 2030), (40, 2040), (41, 1941)}


def test_all_amounts_of_a_line(spark):
    told = "A partir del 1/3/2024 $ 1.200,50 y $ 300\n$ 7 sin fecha\na partir del 31/2/2024 $ 5"
    found = text.amounts(spark.createDataFrame([(1, told)], "id int, t string"), "id", "t").orderBy("place").collect()
    assert [(str(r.since), r.place, str(r.amount)) for r in found] == [("2024-03-01", 0, "1200.50"), ("2024-03-01", 1, "300.00")]


def test_other_wordings_of_ranges(spark):
    told = ["del 1° de enero de 2024 hasta el 3 de marzo", "del 2 de mayo del 2024 al 5 de junio", "de 3 mayo 2024 a 4 mayo 2024"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "id int, t string")
    got = [(str(r.r.start), str(r.r.end), r.r.state) for r in rows.select("id", text.date_range("t").alias("r")).orderBy("id").collect()]
    assert got == [("2024-01-01", "2024-03-03", "DERIVED"), ("2024-05-02", "2024-06-05", "DERIVED"), ("2024-05-03", "2024-05-04", "GIVEN")]


def test_date_ranges_without_years_or_days_stay_pending(spark):
    told = ["del 1 de enero al 3 de marzo", "del 20 de diciembre de 2024 al 5 de enero", "del 31 de febrero de 2024 al 3 de setiembre de 2024", "sin fechas", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "id int, t string")
    got = [(str(r.r.start), str(r.r.end), r.r.state) for r in rows.select("id", text.date_range("t").alias("r")).orderBy("id").collect()]
    assert got == [("None", "None", "PENDING"), ("2024-12-20", "2025-01-05", "DERIVED"), ("None", "None", "PENDING"), ("None", "None", "PENDING"), ("None", "None", "PENDING")]


def test_units_nest_and_close(spark):
    body = ["preámbulo", "TITULO II", "Artículo 10.- uno", "a) x", "sigue", "Artículo 14 bis.- dos", "TITULO III", "a) y"]
    rows = spark.createDataFrame([(1, i, line) for i, line in enumerate(body)], "id int, place int, line string")
    levels = [("titulo", r"^TITULO ([IVX]+)"), ("articulo", r"^Artículo (\d+(?: bis)?)"), ("inciso", r"^([a-z])\)")]
    got = [r.route for r in text.units(rows, "id", levels).orderBy("place").collect()]
    assert got == ["", "titulo-ii", "titulo-ii/articulo-10", "titulo-ii/articulo-10/inciso-a", "titulo-ii/articulo-10/inciso-a", "titulo-ii/articulo-14 bis", "titulo-iii", "titulo-iii/inciso-a"]


def test_blocks_and_links(spark):
    html = "<title>T &amp; Co</title><script>var a='<p>'</script><!-- <p>no</p> --><div>uno <b>dos</b><br>tres</div><a href=\"x/y#z\">l</a>"
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(html, "http://h/a/b?q")], "h string, u string").select(text.paragraphs("h").alias("p"), F.transform(text.links("h"), lambda t: text.absolute(F.col("u"), t)).alias("l")).head()
    assert r.p == ["T & Co", "uno dos", "tres", "l"] and r.l == ["http://h/a/x/y"]
