"""A census that is published anew from time to time: its sheets, and what was known of each place and when."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.sources.files import Refused
from attesta.sources.store import Store

# fixed values: how the names of a sheet's columns begin; they come with their label twice, or edited
COLUMNS = {
    "external_id": ("id renabap",), "name": ("barrio",), "province": ("filtro-provincia", "provincia"), "department": ("departamento",),
    "town": ("localidad",), "families": ("familias",), "dwellings": ("viviendas",),
}
NEEDED = ("external_id", "name")
PAYLOAD = ("name", "province", "department", "town", "families", "dwellings")


def clean(c: Column) -> Column:
    """Without tags; runs of blanks are one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), r"[\s\xA0]+", " "))


def whole(c: Column) -> Column:
    """A whole number whose digits dots and commas may group, else null."""
    digits = F.translate(clean(c), ".,", "")
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))


def headings(names: list[str]) -> dict[str, str]:
    """{field: column} of a sheet: the first column whose name, in lower case, begins as the field's does. Refused without an id or a name."""
    found = {f: next((n for n in names if n.strip().lower().startswith(starts)), None) for f, starts in COLUMNS.items()}
    if missing := [f for f in NEEDED if not found[f]]:
        raise Refused(f"no column for {missing} among {names}")
    return {f: n for f, n in found.items() if n}


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """place, external_id, the payload, fragment, fragment_sha256 of each row of a sheet in CSV; external_id is null where it is blank.

    place numbers rows in the file's order, not without gaps; the fragment tells a row's filled columns. A sheet without rows is refused."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    names = [n.removeprefix("\ufeff") for n in rows.columns]
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    rows = rows.toDF(*(f"c{i}" for i in range(len(names))))
    if not rows.head():
        raise Refused("a sheet without rows")
    of = {f: F.col(at[n]) for f, n in headings(names).items()}
    text = lambda f: F.nullif(clean(of[f]), F.lit("")) if f in of else F.lit(None).cast("string")
    number = lambda f: whole(of[f]) if f in of else F.lit(None).cast("long")
    told = F.concat_ws(" | ", *(F.when(clean(F.col(f"c{i}")) != "", F.concat(F.lit(f"{n}="), clean(F.col(f"c{i}")))) for i, n in enumerate(names)))
    name = F.coalesce(text("name"), F.concat(F.lit("Barrio "), text("external_id")))
    return rows.select(
        F.monotonically_increasing_id().alias("place"), text("external_id").alias("external_id"), name.alias("name"), *(text(f).alias(f) for f in ("province", "department", "town")),
        number("families").alias("families"), number("dwellings").alias("dwellings"), told.alias("fragment"), F.sha2(told, 256).alias("fragment_sha256"),
    )


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row by place of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in (*keys, "place")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct("place", *rest), "place").alias("r")).select(*keys, "r.place", *(F.col(f"r.{c}").alias(c) for c in rest))


def history(sheets: DataFrame) -> DataFrame:
    """All sheets' rows (sheet, seen_on, place, external_id, ...) as versions: version_no, known_from, known_to besides.

    A place keeps its identity from sheet to sheet: each sheet that names it opens a version, which ends what was known before. A place that
    a sheet leaves out stays known as before; one that comes back goes on with the next number. Of a place's rows in a sheet the first
    counts; rows without an id don't. Sheets are told apart by day, then name. One shuffle by place: the first row of each sheet is chosen
    map-side, and the window that follows runs on the same keys.
    """
    kept = once(sheets.filter("external_id is not null"), ["external_id", "sheet", "seen_on"])
    w = Window.partitionBy("external_id").orderBy("seen_on", "sheet")
    return kept.withColumn("version_no", F.row_number().over(w)).withColumn("known_from", F.col("seen_on")).withColumn("known_to", F.lead("seen_on").over(w)).drop("seen_on")


def load(store: Store, rows: DataFrame, name: str, seen_on: dt.date, table: str = "census") -> dict[str, int]:
    """Bring one sheet into the store's table of versions, in one commit: read, new, known, no_id, no_families (of the new rows).

    Read is new + known + no_id. A sheet that is there already, whole or in part, adds only what is missing; nothing else changes then, not
    even the version of the store. Sheets are loaded in the order of their days: an earlier one than a place's newest version is refused.
    """
    change = store.change()
    columns = ["external_id", "version_no", "sheet", *PAYLOAD, "fragment_sha256", "known_from", "known_to"]
    given = rows.withColumn("sheet", F.lit(name)).withColumn("known_from", F.lit(seen_on))
    total = given.agg(F.count("*").alias("read"), F.count_if(F.col("external_id").isNull()).alias("no_id")).first()
    first = once(given.filter("external_id is not null"), ["external_id"])
    if table in change.state:
        held = change.read(table)
        last = held.groupBy("external_id").agg(F.max("version_no").alias("n"), F.max("known_from").alias("at"), F.bool_or(F.col("sheet") == name).alias("here"))
        joined = first.join(last, "external_id", "left").filter("not coalesce(here, false)")
    else:
        joined = first.withColumn("n", F.lit(None).cast("int")).withColumn("at", F.lit(None).cast("date"))
    new = joined.withColumn("version_no", F.coalesce("n", F.lit(0)) + 1).withColumn("known_to", F.lit(None).cast("date"))
    if new.filter("at > known_from").head():
        raise Refused(f"{name} is older than what is known")
    fresh = new.select(*columns)
    if table in change.state:
        ended = held.join(fresh.select("external_id", F.col("known_from").alias("then")), "external_id").filter("known_to is null").withColumn("known_to", F.col("then")).select(*columns)
        added, _ = change.upsert(table, ended.unionByName(fresh), ["external_id", "version_no"])
    else:
        change.replace(table, fresh)
        added = change.read(table).count()
    blank = change.read(table).filter((F.col("sheet") == name) & F.col("families").isNull()).count() if added else 0
    if added:
        change.commit()
    return {"read": total["read"], "new": added, "known": total["read"] - total["no_id"] - added, "no_id": total["no_id"], "no_families": blank}
