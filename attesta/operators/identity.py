"""Identity: which known act a mention means. Catalogue sides are summed to one row a key before they are joined, so nothing multiplies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """mentions (mention_id, official_id, place, number, year) with norm_id and outcome, against a catalogue (norm_id, place, number, year).

    In this order: no place REFUSED; official id known OFFICIAL; exactly one act with place, number and year FULL_KEY, several AMBIGUOUS;
    year missing and exactly one act with place and number UNIQUE_NUMBER, several AMBIGUOUS; else NEW, or NEW_UNCERTAIN if a part is missing.
    """
    keyed = catalogue.filter("place is not null and number is not null")
    one = lambda keys, tag: keyed.groupBy(*keys).agg(F.count("*").alias(f"{tag}_n"), F.min("norm_id").alias(f"{tag}_id"))
    official = catalogue.select(F.col("norm_id").alias("official_id"), F.lit(True).alias("known"))
    named = mentions.filter("official_id is not null").join(official, "official_id", "left")  # rows without an id would all meet in one task
    unnamed = mentions.filter("official_id is null").withColumn("known", F.lit(None).cast("boolean"))
    out = named.unionByName(unnamed).join(one(["place", "number", "year"], "full"), ["place", "number", "year"], "left").join(one(["place", "number"], "part"), ["place", "number"], "left")
    bare = F.col("year").isNull()
    outcome = (
        F.when(F.col("place").isNull(), "REFUSED").when(F.col("known"), "OFFICIAL").when(F.col("full_n") == 1, "FULL_KEY").when(F.col("full_n") > 1, "AMBIGUOUS")
        .when(bare & (F.col("part_n") == 1), "UNIQUE_NUMBER").when(bare & (F.col("part_n") > 1), "AMBIGUOUS").when(bare | F.col("number").isNull(), "NEW_UNCERTAIN").otherwise("NEW")
    )
    marked = out.withColumn("outcome", outcome)
    norm = F.when(F.col("outcome") == "OFFICIAL", F.col("official_id")).when(F.col("outcome") == "FULL_KEY", F.col("full_id")).when(F.col("outcome") == "UNIQUE_NUMBER", F.col("part_id"))
    return marked.select("mention_id", norm.alias("norm_id"), "outcome")


def single(rows: DataFrame, key: str, order: str, other: str) -> DataFrame:
    """One row a key: the first by order, and how many different values of `other` its further rows name."""
    first = F.min(F.struct(order, other)).alias("f")
    return rows.groupBy(key).agg(first, F.count("*").alias("n_rows"), F.count_distinct(other).alias("d")).select(key, F.col(f"f.{order}").alias(order), F.col(f"f.{other}").alias(other), "n_rows", (F.col("d") - 1).alias("n_others"))


def contrast(rows: DataFrame, key: str, component: str, value: str) -> DataFrame:
    """key, component, state, value: AGREE if all sources that speak say the same, CONFLICT (and no value) if they differ, SILENT if none speaks, ONLY_ONE if one does."""
    g = rows.groupBy(key, component).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    state = F.when(F.col("n") == 0, "SILENT").when(F.col("lo") != F.col("hi"), "CONFLICT").when(F.col("n") == 1, "ONLY_ONE").otherwise("AGREE")
    return g.select(key, component, state.alias("state"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))


def completed(acts: DataFrame, views: DataFrame) -> DataFrame:
    """acts (norm_id, type, number, year, title, uncertain) after further views of them (norm_id, place, type, number, year, title), with `outcome`.

    The first view by place that has type, number and year completes an uncertain identity: COMPLETED, and its title counts where it has one.
    A sure identity is never changed: CONFLICT if any such view says otherwise, for somebody to decide, else KEPT. Acts without such a view
    are KEPT as they were. Views are summed to a row an act by partial aggregates, however many an act has.
    """
    identity = F.struct("type", "number", "year")
    full = views.filter("type <> '' and number <> '' and year <> 0")
    seen = full.groupBy("norm_id").agg(F.min_by(F.struct("type", "number", "year", "title"), "place").alias("v"), F.min(identity).alias("lo"), F.max(identity).alias("hi"))
    joined = acts.join(seen, "norm_id", "left")
    differs = (F.col("lo") != identity) | (F.col("hi") != identity)
    outcome = F.when(F.col("v").isNull(), "KEPT").when(F.col("uncertain"), "COMPLETED").when(F.coalesce(differs, F.lit(True)), "CONFLICT").otherwise("KEPT")
    told = joined.withColumn("outcome", outcome)
    done = F.col("outcome") == "COMPLETED"
    pick = lambda c: F.when(done, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c)
    title = F.when(done, F.coalesce(F.nullif("v.title", F.lit("")), "title")).otherwise(F.col("title")).alias("title")
    return told.select("norm_id", pick("type"), pick("number"), pick("year"), title, (F.col("uncertain") & ~done).alias("uncertain"), "outcome")


def equivalences(changes: DataFrame) -> DataFrame:
    """key, from_route, to_route, kind, other_article of the MOVED and MODIFIED units of a diff (key, change, was_route, now_route): RENUMBERED or
    REPLACED, and whether the article that the route passes through is another. Removed and added units correspond to nothing."""
    article = lambda c: F.get(F.filter(F.split(c, "/"), lambda t: t.startswith("article")), F.lit(0))
    kept = changes.filter("change in ('MOVED', 'MODIFIED')").withColumn("to_route", F.coalesce("now_route", "was_route"))
    kind = F.when(F.col("change") == "MOVED", "RENUMBERED").otherwise("REPLACED")
    return kept.select("key", F.col("was_route").alias("from_route"), "to_route", kind.alias("kind"), (~article("was_route").eqNullSafe(article("to_route"))).alias("other_article"))


def redirected(cites: DataFrame, equivalent: DataFrame) -> DataFrame:
    """cites (cite_id, key, route) with `now`, the route that an approved equivalence (key, from_route, to_route, review) leads to, else null: in
    doubt a citation is answered with what it cited. Several approved ones of a route lead nowhere either."""
    approved = equivalent.filter("review in ('APPROVED', 'PUBLISHED')").groupBy("key", F.col("from_route").alias("route")).agg(F.min("to_route").alias("lo"), F.max("to_route").alias("hi"))
    return cites.join(approved.select("key", "route", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("now")), ["key", "route"], "left").select("cite_id", "key", "route", "now")
