"""Fields that acts are searched for: signal phrases in their units, candidates that wait for review, and the state of each field.

A candidate proposes, it doesn't conclude: a field has a value only once a claim on it is approved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the fields, and the phrases by which a unit seems to speak of one. `~` stands for the endings of gender and number, `^` for those
# of a future, `#` for a number, `##` for one of at most two digits, `*` for a word, `|` divides words that may stand in one place.
SIGNALS: dict[str, tuple[str, ...]] = {
    "population": ("destinad~ a", "dirigid~ a", "beneficiari~", "titulares|titular de", "alcanza a", "comprende a", "ser^ beneficiari"),
    "access": (
        "requisitos", "requisito", "deber^ acreditar", "siempre que", "a condicion de", "que acrediten", "no supere", "menores|menor de # años",
        "mayores|mayor de # años",
    ),
    "terms": (
        "plazo de *", "dentro de los * dias", "dentro de * dias", "hasta el ## / ##", "vigencia", "entrara en vigor", "a partir del|de #", "caducara|caduca el",
    ),
    "revocation": (
        "revocacion", "revocar^", "revocase", "caducidad", "caducar^", "se suspendera", "suspension del beneficio", "perdida del beneficio|derecho",
        "cese de la prestacion", "dara de baja",
    ),
    "granted": (
        "consistira en", "se abonara", "prestacion consistente|mensual", "suma de dinero", "asignacion de", "otorgara|otorgase", "tendr^ derecho a percibir",
        "exencion de",
    ),
    "keep": (
        "excepto", "salvo", "no obstante", "sin perjuicio de", "podr^ subsanar", "en caso de imposibilidad", "documentacion alternativa",
        "situaciones especiales", "situaciones especial",
    ),
}
#: The field that relations tell of, not phrases.
RELATED = "interdependencies"
FIELDS = (*SIGNALS, RELATED)
#: How much of a unit a candidate quotes before and after its signal.
BEFORE, AFTER = 60, 200

BLANKS, LETTER = r"[\s\xA0]", r"[\p{L}\p{N}_]"
ACCENTED = str.maketrans({v: f"[{v}{a}]" for v, a in zip("aeiou", "áéíóú", strict=True)})
STANDS_FOR = {"~": "[oa]s?", "^": "[aá]n?", "##": r"\d{1,2}", "#": r"\d+", "*": f"{LETTER}+"}


def pattern(phrases: tuple[str, ...]) -> str:
    """One regular expression for the phrases of a field. A phrase begins where a word does; blanks, of any length and kind, divide its words
    (about a slash there may be none); its last word may go on. At one place the first phrase counts."""

    def word(w: str) -> str:
        parts = re.split(r"(##|[~^#*])", w)
        return "".join(STANDS_FOR.get(p) or re.escape(p).translate(ACCENTED) for p in parts)

    def phrase(p: str) -> str:
        words = ["(?:" + "|".join(map(word, w.split("|"))) + ")" for w in p.split(" ")]
        return f"{BLANKS}+".join(words).replace(f"{BLANKS}+(?:/){BLANKS}+", f"{BLANKS}*/{BLANKS}*")

    # most places end at the first letter, which is looked up in a plain set: no flag for case holds there, as it would make the set slow
    first = {c for p in phrases for w in p.split(" ")[0].split("|") for c in w[0].translate(ACCENTED).strip("[]")}
    begin = "".join(sorted(first | {c.upper() for c in first}))
    return rf"(?=[{begin}])(?<!{LETTER})(?iu:" + "|".join(map(phrase, phrases)) + ")"  # at the beginning of a text the letter before is none


def signals(text: Column, phrases: dict[str, tuple[str, ...]] = SIGNALS) -> Column:
    """array of struct(field, start, signal): for each field, in order, its first signal in a text and where it starts, in characters from 0.

    Accents of vowels and case don't count. Null and empty texts have none. A text is searched once a field, for what is before the signal; the
    signal is what follows, or the text's beginning, if there is one. Both expressions compile their pattern once.
    """
    found = []
    for field, told in phrases.items():
        sought = pattern(told)
        before = F.regexp_extract(text, f"(?s)^(.*?){sought}", 1)
        signal = F.regexp_extract(F.substring(text, F.char_length(before) + 1, F.char_length(text)), f"^{sought}", 0)
        found.append(F.when(signal != "", F.struct(F.lit(field).alias("field"), F.char_length(before).alias("start"), signal.alias("signal"))))
    return F.array_compact(F.array(*found))


def candidates(units: DataFrame, phrases: dict[str, tuple[str, ...]] = SIGNALS) -> DataFrame:
    """version_id, unit_id, field, signal, start, fragment, fragment_sha256 of units (version_id, unit_id, role, text) that enact: a row for
    each field that a unit seems to speak of. Units that quote or substitute speak for another act."""
    # signals are a column before they become rows, and these by an outer generator: else Spark reads a text once for each use of what it
    # finds, and again for a filter that it infers
    read = units.filter("role = 'ENACTING'").select("version_id", "unit_id", "text", signals(F.col("text"), phrases).alias("found"))
    found = read.select("version_id", "unit_id", "text", F.inline_outer("found")).filter("field is not null")
    begins = F.greatest(F.col("start") - BEFORE, F.lit(0))
    quoted = F.substring("text", begins + 1, F.col("start") + F.char_length("signal") + AFTER - begins)
    ends = f"^{BLANKS}+|{BLANKS}+$"
    return found.withColumn("fragment", F.regexp_replace(quoted, ends, "")).select(
        "version_id", "unit_id", "field", "signal", "start", "fragment", F.sha2("fragment", 256).alias("fragment_sha256")
    )


def interdependencies(relations: DataFrame) -> DataFrame:
    """version_id, n: how many relations (from_id, to_id) each act has, on either side. One that leads to itself counts on both."""
    sides = relations.select(F.explode(F.array("from_id", "to_id")).alias("version_id"))
    return sides.filter("version_id is not null").groupBy("version_id").agg(F.count("*").alias("n"))


def states(versions: DataFrame, claims: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """version_id, field, state, n: each field of each version (version_id, unique), evaluated by its claims (version_id, field, review, informed).

    INFORMED by its approved or published claims that inform, else PENDING by its candidates, else NOT_INFORMED; n counts them. Claims are
    summed to a row a version before the join, so a version or field with many of them costs one row. Claims on other fields don't count.
    """

    def count(c: Column, alias: str) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False))).alias(alias)

    known = claims.filter(F.col("field").isin(*fields)).groupBy("version_id").agg(
        *(count((F.col("field") == f) & F.col("review").isin("APPROVED", "PUBLISHED") & F.col("informed"), f"a{i}") for i, f in enumerate(fields)),
        *(count((F.col("field") == f) & (F.col("review") == "CANDIDATE"), f"c{i}") for i, f in enumerate(fields)),
    )
    each = []
    for i, f in enumerate(fields):
        approved, waiting = (F.coalesce(f"{k}{i}", F.lit(0)) for k in "ac")
        state = F.when(approved > 0, "INFORMED").when(waiting > 0, "PENDING").otherwise("NOT_INFORMED")
        each.append(F.struct(F.lit(f).alias("field"), state.alias("state"), F.when(approved > 0, approved).otherwise(waiting).alias("n")))
    return versions.select("version_id").join(known, "version_id", "left").select("version_id", F.inline(F.array(*each)))


def completeness(evaluated: DataFrame) -> DataFrame:
    """field, evaluated, informed, pending, not_informed, informed_share of states(): having searched for a field isn't having its value."""
    n = lambda s: F.count_if(F.col("state") == s)
    return evaluated.groupBy("field").agg(
        F.count("*").alias("evaluated"), n("INFORMED").alias("informed"), n("PENDING").alias("pending"), n("NOT_INFORMED").alias("not_informed"),
        (n("INFORMED") / F.count("*")).alias("informed_share"),
    )
