"""File sources: zipped catalogues, directories, holidays and decisions, each read whole or refused with the reason."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.strings import wkt_point

# fixed values: literals that mean no data or no number, the catalogue's header, its types, and the kinds that a jurisdiction numbers
NO_DATA = ("", "n/a", "na", "s/d", "sd", "-", "--", "sin datos", "no informa", "null")
NO_NUMBER = ("", "s/n", "s/nº", "s/n°", "sn")
HEADER = (
    "id_norma", "tipo_norma", "numero_norma", "clase_norma", "organismo_origen", "fecha_sancion", "numero_boletin", "fecha_boletin", "pagina_boletin", "titulo_resumido",
    "titulo_sumario", "texto_resumido", "observaciones", "texto_original", "texto_actualizado", "modificada_por", "modifica_a",
)
TYPES = {
    "ley": "LEY", "decreto": "DECRETO", "decreto/ley": "DECRETO_LEY", "decreto ley": "DECRETO_LEY", "resolución": "RESOLUCION", "resolucion": "RESOLUCION",
    "disposición": "DISPOSICION", "disposicion": "DISPOSICION", "acordada": "ACORDADA",
}
# fixed value: the types that a jurisdiction numbers as one series
NUMBERED_AS_ONE = ("LEY", "DECRETO", "DECRETO_LEY")

# fixed values: bytes that a catalogue may unpack to, and rows of it that are handed on at once.
UNPACKED, BATCH = 2 << 30, 5000


class Refused(ValueError):
    """A file that isn't what it should be: nothing of it is loaded."""


def given(column: str) -> Column:
    """A trimmed value, or null where it says that there is no data."""
    value = F.trim(F.col(f"`{column}`"))
    return F.when(~F.lower(value).isin(*NO_DATA), value)


def unpacked(content: bytes, header: tuple[str, ...], most: int) -> Iterator[pd.DataFrame]:
    """The rows of the one CSV file of an archive, in batches; the archive is never written out."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = archive.namelist()
    if bad := [n for n in names if n.startswith("/") or ".." in PurePosixPath(n).parts]:
        raise Refused(f"the archive has a path outside its tree: {bad[0]!r}")
    tables = [n for n in names if n.lower().endswith(".csv")]
    if len(tables) != 1:
        raise Refused(f"the archive has {len(tables)} CSV files, not one")
    if archive.getinfo(tables[0]).file_size > most:  # a member is never read beyond the size that it declares
        raise Refused("the archive declares more bytes than it may unpack to")
    reader = csv.reader(io.TextIOWrapper(archive.open(tables[0]), "utf-8-sig", "replace", newline=""))
    if (first := tuple(next(reader, ()))) != header:
        raise Refused(f"the columns have changed: {first}")
    rows: list[list[str]] = []
    for row in reader:
        if row:
            rows.append((row + [None] * len(header))[: len(header)])
        if len(rows) == BATCH:
            yield pd.DataFrame(rows, columns=list(header))
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=list(header))


def catalogue(spark: SparkSession, path: str, header: tuple[str, ...] = HEADER, most: int = UNPACKED) -> DataFrame:
    """The rows of zipped CSV files as text. An archive is one task's work, as its compression can't be split, and is read as a stream.

    A query fails, with the reason, on an archive with a path outside its tree, with other than one CSV file, with another header, or one
    of more than `most` bytes unpacked."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from unpacked(content, header, most)

    return files.mapInPandas(run, ", ".join(f"{c} string" for c in header))


def identities(rows: DataFrame) -> DataFrame:
    """external_id, type, number, year, issuer, title, text_url, uncertain, metadata_only, n_rows: an act for each id of a catalogue.

    The number is null where it says that there is none. An identity with a key is uncertain unless its type is numbered by jurisdiction and
    no other id has the same three: of homonyms none is certain. Without number or year there is no key to doubt. The
    year is that of the sanction, else of the gazette; the title the short one, else the summary. Of several rows of one id the first by
    issuer counts.
    """
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    number = F.trim(F.coalesce("numero_norma", F.lit("")))
    url = F.coalesce(given("texto_actualizado"), given("texto_original"))
    day = lambda c: F.try_to_date(F.trim(c), "yyyy-MM-dd")
    year = F.year(F.coalesce(day("fecha_sancion"), day("fecha_boletin")))
    read = rows.select(
        F.trim("id_norma").alias("external_id"), F.coalesce(types[F.lower(F.trim("tipo_norma"))], F.lit("OTRO")).alias("type"), F.when(~F.lower(number).isin(*NO_NUMBER), number).alias("number"),
        year.alias("year"), given("organismo_origen").alias("issuer"), F.coalesce(given("titulo_resumido"), given("titulo_sumario")).alias("title"), url.alias("text_url"),
    ).filter("external_id <> ''")
    names = ["issuer", "type", "number", "year", "title", "text_url"]
    one = read.groupBy("external_id").agg(F.min(F.struct(*names)).alias("a"), F.count("*").alias("n_rows")).select("external_id", "a.*", "n_rows")
    keyed = F.col("number").isNotNull() & F.col("year").isNotNull()
    whole = F.col("type").isin(*NUMBERED_AS_ONE) & keyed
    shared = one.filter(whole).groupBy("type", "number", "year").agg(F.count("*").alias("same"))
    joined = one.withColumn("whole", whole).join(shared, ["type", "number", "year"], "left")
    return joined.select("external_id", *names, (keyed & (~F.col("whole") | F.coalesce(F.col("same") > 1, F.lit(False)))).alias("uncertain"), F.col("text_url").isNull().alias("metadata_only"), "n_rows")


# fixed values: longitudes and latitudes that a point of the country can have
BOUNDS = (-74.0, -53.0, -56.0, -21.0)


def directory(spark: SparkSession, path: str, columns: dict[str, str], bounds: tuple[float, float, float, float] = BOUNDS) -> DataFrame:
    """A row for each row of a directory in CSV: label, address, phone, email, web, lat, lng, place, accepted, fragment, fragment_sha256.

    `columns` names the file's column of each field (name, detail, address, phone, email, web, geometry); the file must have those of the name and the address.
    Values that say that there is no data are null; a row without a name isn't accepted. `place` is USABLE, NONE, or NO_CRS for a geometry
    that can't be a longitude and latitude within the bounds; it isn't turned into one. The fragment tells the row's filled columns.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*(c.removeprefix("\ufeff") for c in rows.columns))
    for needed in ("name", "address"):
        if columns.get(needed) not in rows.columns:
            raise Refused(f"no column {columns.get(needed)} among {rows.columns}")
    field = lambda f: given(columns[f]) if columns.get(f) in rows.columns else F.lit(None).cast("string")
    point = wkt_point(field("geometry"), *bounds)
    told = F.concat_ws(" | ", *(F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(f"`{c}`")))) for c in rows.columns))
    return rows.select(
        F.when(field("name").isNotNull(), F.concat_ws(" — ", field("name"), field("detail"))).alias("label"), *(field(f).alias(f) for f in ("address", "phone", "email", "web")),
        point["y"].alias("lat"), point["x"].alias("lng"), F.when(field("geometry").isNull(), "NONE").when(point.isNull(), "NO_CRS").otherwise("USABLE").alias("place"),
        field("name").isNotNull().alias("accepted"), told.alias("fragment"), F.sha2(told, 256).alias("fragment_sha256"),
    )


HOLIDAYS = "mainEntity struct<itemListElement: array<struct<item: struct<name: string, startDate: string, additionalProperty: struct<value: string>>>>>"


def holidays(spark: SparkSession, path: str, year: int) -> DataFrame:
    """day, reason of the holidays of a year in a JSON file, one a day: the last that the file names.

    Other years and days that don't exist are left out. A file without the list is refused, and so is one without a holiday of the year: an
    empty calendar would make every deadline wrong."""
    files = spark.read.schema(HOLIDAYS).json(path, multiLine=True).select(F.col("mainEntity.itemListElement").alias("items"))
    if files.filter("items is null").head():
        raise Refused("the file lacks mainEntity.itemListElement")
    each = files.select(F.posexplode("items").alias("place", "x")).select("place", "x.item.*")
    day = F.try_to_date(F.trim("startDate"), "yyyy-MM-dd")
    name = F.regexp_replace(F.trim(F.coalesce("name", F.lit("Feriado"))), r"\.+$", "")
    kind = F.trim(F.coalesce("additionalProperty.value", F.lit("")))
    told = each.select("place", day.alias("day"), F.when(kind == "", name).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")"))).alias("reason")).filter(F.year("day") == year)
    found = told.groupBy("day").agg(F.max_by("reason", "place").alias("reason"))
    if not found.head():
        raise Refused(f"no holiday of {year}")
    return found


UUID = "(?i)^[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}$"


def decision_faults(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """rows (place, rule, decision, reason), trimmed, with `fault`: BAD_ID, UNKNOWN_DECISION, NO_REASON, REPEATED (the rule was decided by an
    earlier row without a fault), or null."""
    clean = rows.select("place", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("rule", "decision", "reason"))).withColumn("decision", F.upper("decision"))
    rule = F.lower(F.replace("rule", F.lit("-"), F.lit("")))
    fault = F.when(~F.col("rule").rlike(UUID), "BAD_ID").when(~F.col("decision").isin(*known), "UNKNOWN_DECISION").when(F.col("reason") == "", "NO_REASON")
    turn = F.row_number().over(Window.partitionBy(rule, fault.isNull()).orderBy("place"))
    return clean.withColumn("fault", F.coalesce(fault, F.when(turn > 1, "REPEATED")))


def decisions(spark: SparkSession, path: str, known: tuple[str, ...]) -> DataFrame:
    """place, rule, decision, reason of a file of decisions, CSV or JSON (by its ending). One faulty row, or none at all, and the whole file is refused."""
    names = {"rule": "regla", "decision": "decision", "reason": "fundamento"}
    rows = spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    column = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    judged = decision_faults(rows.select(F.monotonically_increasing_id().alias("place"), *(column(c).alias(n) for n, c in names.items())), known)
    found = judged.groupBy("fault").count().collect()  # a row for each kind of fault
    if not found or any(r.fault for r in found):
        raise Refused(f"nothing is applied: { {r.fault: r['count'] for r in found if r.fault} or 'no rows'}")
    return judged.drop("fault")
