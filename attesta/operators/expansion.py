"""Which acts that the corpus cites and lacks could be brought in, and why the others can't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the last part of an address tells the consolidated text from the one that was published; the former is preferred
CONSOLIDATED, PUBLISHED = "texact.htm", "norma.htm"


def expansion(pending: DataFrame, catalogue: DataFrame, known: DataFrame) -> DataFrame:
    """act, number, year, cites, outcome, norm_id, url, form: a row for each act that pending citations (act, number, year) name.

    cites is how many name it. The catalogue (norm_id, act, number, year, uncertain, url) may hold an act's several addresses; known (url)
    holds those that are in the corpus. Outcomes, in this order: NO_YEAR, NOT_FOUND, AMBIGUOUS (several acts), UNCERTAIN, NO_TEXT (no address
    of either form), PRESENT, ADD. Only the last two have an address, always by https. Of several of a form the first in order counts.
    Citations are counted, and the catalogue summed to a row an identity, before they meet, so no identity that is cited often is one task's.
    """
    sought = pending.filter("act is not null and number is not null").groupBy("act", "number", "year").agg(F.count("*").alias("cites"))
    by_form = lambda form: F.min(F.when(F.endswith("url", F.lit(form)), F.struct(F.col("url"), F.lit(form).alias("form"))))
    acts = catalogue.filter("year is not null").groupBy("act", "number", "year").agg(
        (F.min("norm_id") != F.max("norm_id")).alias("several"), F.min("norm_id").alias("one"), F.bool_or(F.coalesce("uncertain", F.lit(False))).alias("uncertain"),
        F.coalesce(by_form(CONSOLIDATED), by_form(PUBLISHED)).alias("text"),
    )
    dated = sought.filter("year is not null").join(acts, ["act", "number", "year"], "left")
    url = F.regexp_replace("text.url", "^http://", "https://")
    reason = F.when(F.col("one").isNull(), "NOT_FOUND").when(F.col("several"), "AMBIGUOUS").when(F.col("uncertain"), "UNCERTAIN").when(F.col("text").isNull(), "NO_TEXT")
    judged = dated.select("act", "number", "year", "cites", reason.alias("reason"), F.when(~F.col("several"), F.col("one")).alias("norm_id"), url.alias("url"), F.col("text.form").alias("form"))
    here = known.select("url").distinct().withColumn("here", F.lit(True))
    found = judged.filter("reason is null").join(here, "url", "left")
    good = found.select("act", "number", "year", "cites", F.when(F.col("here"), "PRESENT").otherwise("ADD").alias("outcome"), "norm_id", "url", "form")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    bad = judged.filter("reason is not null").select("act", "number", "year", "cites", F.col("reason").alias("outcome"), "norm_id", none("url", "string"), none("form", "string"))
    bare = sought.filter("year is null").select("act", "number", "year", "cites", F.lit("NO_YEAR").alias("outcome"), none("norm_id", catalogue.schema["norm_id"].dataType), none("url", "string"), none("form", "string"))
    return good.unionByName(bad).unionByName(bare)
