"""Scalar functions over text columns: all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the letters without, place by place.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that name a kind of street and don't tell streets apart.
STREET_KINDS = ("avenida", "av", "calle", "pasaje", "pje", "boulevard", "bv")
#: Numbers from zero to twenty in words.
NUMBER_WORDS = (
    "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce",
    "quince", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte",
)


def fold(text: Column) -> Column:
    """Letters without their marks; other characters stay."""
    return F.translate(text, MARKED, PLAIN)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def comparable_key(text: Column) -> Column:
    """Folded and lower-cased, without dots; each run of what is no letter a-z is one blank, none at the ends."""
    letters = F.regexp_replace(F.regexp_replace(ascii_lower(fold(text)), "[.]", ""), "[^a-z]+", " ")
    return F.trim(letters)


def slug(text: Column, most: int = 80) -> Column:
    """Upper-case and folded; runs of blanks are one hyphen, other characters than A-Z, 0-9, hyphen, underscore and dot go."""
    up = F.translate(fold(text), LOWER, UPPER)
    return F.substring(F.regexp_replace(F.regexp_replace(up, " +", "-"), "[^A-Z0-9_.-]", ""), 1, most)


def street_key(street: Column) -> Column:
    """The words of a street's name in order, without kinds of street and digits."""
    words = F.split(comparable_key(street), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*STREET_KINDS))), " ")


def address(text: Column) -> Column:
    """struct(street, height, floor): floor after the word Piso, height the last number of two to five digits before it, street
    what is before that."""
    floor = F.nullif(F.regexp_extract(text, "(?i)piso +([0-9]+)", 1), F.lit(""))
    rest = F.regexp_replace(text, "(?i) *,? *piso +[0-9]+.*$", "")
    numbers = F.regexp_extract_all(rest, F.lit(r"\b([0-9]{2,5})\b"), F.lit(1))
    height = F.when(F.size(numbers) > 0, F.element_at(numbers, -1))
    street = F.trim(F.when(height.isNull(), rest).otherwise(F.substring(rest, F.lit(1), F.position(height, rest) - 1)))
    return F.struct(street.alias("street"), height.cast("int").alias("height"), floor.cast("int").alias("floor"))


def territorial_scope(name: Column) -> Column:
    """PROVINCIAL or MUNICIPAL where the name says so in words, else NO_DECLARADO."""
    key = F.concat(F.lit(" "), comparable_key(name), F.lit(" "))
    municipal = key.rlike(" (municipalidad|municipal|municipio) ")
    return F.when(municipal, "MUNICIPAL").when(key.rlike(" (provincia|provincial) "), "PROVINCIAL").otherwise("NO_DECLARADO")


def wkt_point(text: Column, west: float, east: float, south: float, north: float) -> Column:
    """struct(x, y) of POINT(x y) within bounds, else null."""
    shape = r"^ *POINT *\( *(-?[0-9]+(?:[.][0-9]+)?) +(-?[0-9]+(?:[.][0-9]+)?) *\) *$"
    x, y = (F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(x.between(west, east) & y.between(south, north), F.struct(x.alias("x"), y.alias("y")))


def transposed(a: Column, b: Column) -> Column:
    """Whether two numbers, as text, have the same digits in another order."""
    return (a != b) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def full_year(two: Column) -> Column:
    """The year of two digits: above 40 in the twentieth century, else in the twenty-first."""
    return F.when(two > 40, two + 1900).otherwise(two + 2000)


def supports(text: Column, number: Column) -> Column:
    """Whether a text says a whole number, in digits or, up to twenty, in words."""
    said = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(fold(text)), "[^a-z0-9]+", " "), F.lit(" "))
    words = F.array(*map(F.lit, NUMBER_WORDS))
    word = F.when(number.between(0, len(NUMBER_WORDS) - 1), F.get(words, number))
    return F.contains(said, F.concat(F.lit(" "), number.cast("string"), F.lit(" "))) | F.coalesce(F.contains(said, F.concat(F.lit(" "), word, F.lit(" "))), F.lit(False))


def page_key(url: Column) -> Column:
    """Path and query of a URL, without scheme, host, fragment and a closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-z]+://[^/?]+", ""), "/$", "")
