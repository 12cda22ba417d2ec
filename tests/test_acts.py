"""Relations, dates and digests on small fixtures."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from attesta.operators import relational, relations

DAY = dt.date(2006, 4, 12)


def test_dates_of_documents(spark):
    told = [
        ("Buenos Aires, 12 de abril de 2006\nVisto", DAY, "GIVEN", []), ("Dada a los 12 días del mes de ABRIL del año 2006", DAY, "GIVEN", []),
        ("Buenos Aires, 12 de abril de 2006\n(Texto sustituido por Decreto N° 148/2021 (B.O. 6112), 3/5/2021)", DAY, "GIVEN", ["Decreto 148/2021"]),
        ("Art. 1 (incorporado el 3 de mayo de 2021)", None, "OTHER_ACTS", ["UNIDENTIFIED"]), ("visto el 31/2/2001", None, "NO_DATE", []), ("visto el 3/2/2001 (nota)", None, "LOOSE", []),
        ("Buenos Aires, 12 de abril de 2006\nLa Plata, 13 de abril de 2006", None, "SEVERAL", []), ("  ", None, "NO_TEXT", []), (None, None, "NO_TEXT", []),
        ("Buenos Aires, 12 de abril de 2006 (" + "x" * 16_000 + ")", DAY, "GIVEN", []), ("(" * 50_000 + " 3/5/2021 " + ")" * 50_000, None, "LOOSE", []),
        ("Buenos Aires, 12 de abril de 2006 (nota (derogado por LEY Nº 1.234/98) 12 de abril de 2006", DAY, "GIVEN", []),
        ("(a (b) modificado por Ley 5/2001, Buenos Aires, 12 de abril de 2006)", None, "OTHER_ACTS", ["Ley 5/2001"]), ("a los 12 días del mes de abril del año 2006 (sustituido el", DAY, "GIVEN", []),
    ]
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(told)], "i int, t string").select("i", relations.document_date(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r.r.date, r.r.state, r.r.acts) for r in rows] == [t[1:] for t in told]


def test_citations_resolve_to_one_certain_act(spark):
    acts = spark.createDataFrame([(1, 1, "ley", 5, 2000, False), (2, 1, "ley", 5, 2001, False), (3, 1, "ley", 6, 2001, False), (4, 2, "ley", 6, 2001, False), (5, 1, "ley", 7, 2001, True)], "act_id int, jurisdiction int, type string, number int, year int, uncertain boolean")
    told = [(3, 1, 30, "ley", 5, 2000, "AMENDS"), (3, 1, 30, "ley", 5, None, "CITES"), (1, 1, 10, "ley", 6, None, "REPEALED_BY"), (3, 1, 31, "ley", 6, 2001, "CITES"), (1, 1, 10, "ley", 7, 2001, "CITES"), (3, 1, 30, "ley", 5, 2000, "AMENDS")]
    cites = relations.resolved(spark.createDataFrame(told, "act_id int, jurisdiction int, unit_id int, act string, number int, year int, relation string"), acts)
    assert {tuple(r) for r in relations.relations(cites, {"REPEALED_BY": "REPEALS"}).collect()} == {(3, 1, "AMENDS", 30, None), (3, 1, "REPEALS", None, 10)}
    assert {tuple(r) for r in relations.pending(cites).collect()} == {(3, "ley", 5, None, "CITES", 2), (1, "ley", 7, 2001, "CITES", 0)}


def test_digests_tell_sets_apart_whatever_the_order(spark):
    def digests(ids, span=2):
        rows = spark.createDataFrame([("k", i) for i in ids], "k string, i long")
        return [(r.n, r.digest) for r in relational.digests(rows, "k", "i", span).collect()]

    sha = lambda *parts: hashlib.sha256(f"[{','.join(map(str, parts))}]".encode()).hexdigest()
    want = sha(sha(sha(0, 1), sha(3)), sha(sha(9)))
    assert digests([9, 3, 1, 0]) == digests([0, 0, 1, 3, 9]) == [(4, sha(sha(sha(0, 1), sha(3)), sha(sha(9))))] and digests([0, 1, 3]) != digests([0, 1, 9])
    assert want == digests([9, 3, 1, 0])[0][1] and digests([]) == []
