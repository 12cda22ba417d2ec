"""Sheets of a census in files, and what is known of places after several of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.sources import census as C
from attesta.sources.files import Refused
from attesta.sources.store import Store


def write(path, *rows, head="ID Renabap ID Renabap,Barrio Barrio,Filtro-Provincia,Localidad,Familias Familias"):
    path.write_text("\ufeff" + "\n".join([head, *rows]) + "\n", encoding="utf-8")
    return str(path)


def versions(store):
    return sorted((r.external_id, r.version_no, r.sheet, r.name, r.families, str(r.known_from), str(r.known_to or "")) for r in store.read("census").collect())


def test_sheet_by_the_beginnings_of_its_headings(spark, tmp_path):
    path = write(tmp_path / "a.csv", '<b>12</b>,"Villa  <i>Sol</i>, norte",Chaco,,"1.234"', "13,,,Pila,s/d", ",Sin id,,,5", '14,"Dos\nlíneas",,,"1,2"')
    rows = {r.external_id: r for r in C.sheet(spark, path).collect()}
    assert {k: (r.name, r.province, r.town, r.families, r.dwellings) for k, r in rows.items()} == {
        "12": ("Villa Sol, norte", "Chaco", None, 1234, None), "13": ("Barrio 13", None, "Pila", None, None), None: ("Sin id", None, None, 5, None), "14": ("Dos líneas", None, None, 12, None),
    }
    assert rows["13"].fragment == "ID Renabap ID Renabap=13 | Localidad=Pila | Familias Familias=s/d"


def test_sheets_without_names_or_rows_are_refused(spark, tmp_path):
    with pytest.raises(Refused, match="name"):
        C.sheet(spark, write(tmp_path / "a.csv", "1,2", head="Id Renabap,Provincia"))
    with pytest.raises(Refused, match="without rows"):
        C.sheet(spark, write(tmp_path / "b.csv"))


def test_one_gone_one_back_one_new(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    a = C.sheet(spark, write(tmp_path / "a.csv", "1,Uno,,,10", "2,Dos,,,", "1,Otra,,,99", ",x,,,"))
    b = C.sheet(spark, write(tmp_path / "b.csv", "2,Dos,,,20", "3,Tres,,,30"))
    c = C.sheet(spark, write(tmp_path / "c.csv", "1,Uno,,,11", "2,Dos,,,20"))
    days = [dt.date(2024, m, 1) for m in (1, 2, 3)]
    assert C.load(store, a, "a", days[0]) == {"read": 4, "new": 2, "known": 1, "no_id": 1, "no_families": 1}
    assert C.load(store, b, "b", days[1]) == {"read": 2, "new": 2, "known": 0, "no_id": 0, "no_families": 0}
    before = store.version()
    assert C.load(store, b, "b", days[1])["new"] == 0 and store.version() == before
    C.load(store, c, "c", days[2])
    want = [
        ("1", 1, "a", "Uno", 10, "2024-01-01", "2024-03-01"), ("1", 2, "c", "Uno", 11, "2024-03-01", ""), ("2", 1, "a", "Dos", None, "2024-01-01", "2024-02-01"),
        ("2", 2, "b", "Dos", 20, "2024-02-01", "2024-03-01"), ("2", 3, "c", "Dos", 20, "2024-03-01", ""), ("3", 1, "b", "Tres", 30, "2024-02-01", ""),
    ]
    assert versions(store) == want
    with pytest.raises(Refused, match="older"):
        C.load(store, b, "late", days[0])
    assert versions(store) == want
    every = [s.withColumn("sheet", F.lit(n)).withColumn("seen_on", F.lit(d)) for s, n, d in zip((a, b, c), "abc", days, strict=True)]
    found = C.history(every[0].unionByName(every[1]).unionByName(every[2])).collect()
    assert sorted((r.external_id, r.version_no, r.sheet, r.name, r.families, str(r.known_from), str(r.known_to or "")) for r in found) == want
    assert C.history(every[0].limit(0)).count() == 0
