"""File sources on small files: what is read, what is refused."""

import csv
import io
import json
import zipfile

import pytest

from attesta.sources import files


def zipped(path, rows, header=files.HEADER, name="c.csv", extra=()):
    body = io.StringIO()
    csv.writer(body).writerows([header, *rows])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, "\ufeff" + body.getvalue())
        for e in extra:
            z.writestr(e, "x")
    return str(path)


def act(id_, kind, number, day, issuer="A", url="", gazette="", short='Título, "uno"\nsigue'):
    return [id_, kind, number, "", issuer, day, "", gazette, "", short, "Sumario", "", "", url, "", "0", "0"]


def test_catalogue_identities(spark, tmp_path):
    rows = [
        act("1", "Ley", "24714", "1996-10-02", url="http://h/1"), act("2", "Decreto", "1", "2001-01-05"), act("3", "Decreto", "1", "2001-02-05"), act("4", "Ley", "S/N", "1990-01-01"),
        act("5", "Resolución", "1", "2023-01-01", "B"), act("5", "Resolución", "1", "2023-01-01", "A"), act("6", "Acta", "2", "sin fecha"),
        act("7", "Ley", "9", "", gazette="1990-03-04", short=""),
    ]
    got = {r.external_id: r for r in files.identities(files.catalogue(spark, zipped(tmp_path / "a.zip", rows))).collect()}
    assert {k: (r.type, r.number, r.year, r.uncertain, r.metadata_only, r.n_rows) for k, r in got.items()} == {
        "1": ("LEY", "24714", 1996, False, False, 1), "2": ("DECRETO", "1", 2001, True, True, 1), "3": ("DECRETO", "1", 2001, True, True, 1), "4": ("LEY", None, 1990, False, True, 1),
        "5": ("RESOLUCION", "1", 2023, True, True, 2), "6": ("OTRO", "2", None, False, True, 1),
        "7": ("LEY", "9", 1990, False, True, 1),
    }
    assert got["7"].title == "Sumario" and got["5"].issuer == "A" and got["1"].title == 'Título, "uno"\nsigue'


@pytest.mark.parametrize(
    ("told", "kind"), [("columns", {"header": ("a", "b")}), ("outside", {"extra": ("../x",)}), ("2 CSV", {"extra": ("d.csv",)}), ("0 CSV", {"name": "c.txt"})]
)
def test_other_archives_are_refused(spark, tmp_path, told, kind):
    path = zipped(tmp_path / "a.zip", [], **kind)
    with pytest.raises(Exception, match=told):
        files.catalogue(spark, path).collect()


def test_an_archive_unpacks_to_so_many_bytes_only(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", [act("1", "Ley", "1", "1996-10-02")] * 50)
    assert files.catalogue(spark, path).count() == 50
    with pytest.raises(Exception, match="more bytes"):
        files.catalogue(spark, path, most=100).collect()


def test_directory(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('\ufeffnam,sag,dir,tel,geometry\nSede 1,,"Calle 1, piso 2",,POINT (28615.8 70947.0)\nSede 2,Anexo,N/A,4300-1000,POINT (-58.4 -34.6)\ns/d,,x,,\n', "utf-8")
    rows = files.directory(spark, str(path), {"name": "nam", "detail": "sag", "address": "dir", "phone": "tel", "geometry": "geometry"}).collect()
    assert [(r.label, r.address, r.phone, r.email, r.lat, r.lng, r.place, r.accepted) for r in rows] == [
        ("Sede 1", "Calle 1, piso 2", None, None, None, None, "NO_CRS", True), ("Sede 2 — Anexo", None, "4300-1000", None, -34.6, -58.4, "USABLE", True), (None, "x", None, None, None, None, "NONE", False),
    ]
    assert rows[2].fragment == "nam=s/d | dir=x"
    with pytest.raises(files.Refused):
        files.directory(spark, str(path), {"name": "nombre"})


def test_holidays(spark, tmp_path):
    item = lambda day, name="Fiesta.", kind=None: {"item": {"name": name, "startDate": day, "additionalProperty": {"value": kind}}}
    path = tmp_path / "h.json"
    path.write_text(json.dumps({"mainEntity": {"itemListElement": [item("2026-03-24", kind="inamovible"), item("2025-01-01"), item("2026-02-31"), item("2026-05-01", None), item(None)]}}), "utf-8")
    assert sorted((str(r.day), r.reason) for r in files.holidays(spark, str(path), 2026).collect()) == [("2026-03-24", "Fiesta (inamovible)"), ("2026-05-01", "Feriado")]
    with pytest.raises(files.Refused, match="2024"):
        files.holidays(spark, str(path), 2024)
    for body, told in (({"mainEntity": {}}, "lacks"), ({"mainEntity": {"itemListElement": []}}, "no holiday")):
        path.write_text(json.dumps(body), "utf-8")
        with pytest.raises(files.Refused, match=told):
            files.holidays(spark, str(path), 2026)


def test_decisions_are_all_applied_or_none(spark, tmp_path):
    one, two = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"
    path = tmp_path / "d.csv"
    path.write_text(f'regla,decision,fundamento\n{one},aprobar,"así, es"\n{two},RECHAZAR,no\n', "utf-8")
    known = ("APROBAR", "RECHAZAR")
    assert [(r.rule, r.decision, r.reason) for r in files.decisions(spark, str(path), known).orderBy("place").collect()] == [(one, "APROBAR", "así, es"), (two, "RECHAZAR", "no")]
    rows = [(0, "x", "APROBAR", "r"), (1, one, "OTRA", "r"), (2, one, "APROBAR", " "), (3, one, "APROBAR", "r"), (4, one.upper(), "RECHAZAR", "r"), (5, None, None, None)]
    faults = files.decision_faults(spark.createDataFrame(rows, "place int, rule string, decision string, reason string"), known)
    assert [r.fault for r in faults.orderBy("place").collect()] == ["BAD_ID", "UNKNOWN_DECISION", "NO_REASON", None, "REPEATED", "BAD_ID"]
    bad = tmp_path / "d.json"
    bad.write_text(json.dumps([{"regla": one, "decision": "APROBAR"}]), "utf-8")
    with pytest.raises(files.Refused, match="NO_REASON"):
        files.decisions(spark, str(bad), known)
