"""Serving on two time axes: validity is closed at both ends, knowledge is half-open, freshness is a third clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRESOLVED = ("UNKNOWN", "CONDITIONAL")
GRAVE = ("HIGH", "CRITICAL")
UNSETTLED = ("OPEN", "IN_REVIEW")


def range_resolved() -> Column:
    """A range is resolved if its kind is known and at least one end is given."""
    return ~F.col("valid_kind").isin(*UNRESOLVED) & ~(F.col("valid_from").isNull() & F.col("valid_to").isNull())


def range_contains(day: Column) -> Column:
    """True only for a resolved range that holds the day; both ends are inclusive."""
    return range_resolved() & (F.col("valid_from").isNull() | (day >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))


def known_at(day: Column) -> Column:
    return (F.col("known_from") <= day) & (F.col("known_to").isNull() | (F.col("known_to") > day))


def grave_open(incidents: DataFrame) -> DataFrame:
    """The versions with an unsettled grave incident, once each."""
    return incidents.filter(F.col("severity").isin(*GRAVE) & F.col("state").isin(*UNSETTLED)).select("version_id").distinct()


def with_reasons(versions: DataFrame, releases: DataFrame, incidents: DataFrame, evaluations: DataFrame, valid_on: Column, known_on: Column, critical: dict[str, tuple[str, ...]]) -> DataFrame:
    """versions plus `reasons`, all the reasons in order why each can't be served; none means it can.

    `critical` names the critical fields of each declared capability. After the other reasons come those of its critical fields that
    `evaluations` (version_id, field, state) has in a state other than INFORMED, then those of its fields without an evaluation. Of
    several evaluations of a field the last state by name counts. The release, incident and evaluation sides are summed to a row per key
    before they are joined, so none multiplies rows.
    """
    told = told_states(evaluations, critical)
    published = releases.filter("state = 'PUBLISHED'").select("release_no", F.lit(True).alias("released"))
    blocked = grave_open(incidents).withColumn("blocked", F.lit(True))
    joined = versions.join(published, "release_no", "left").join(blocked, "version_id", "left").join(told, "version_id", "left")
    cases = [
        (F.col("review_state") != "PUBLISHED", "NOT_PUBLISHED"),
        (F.col("released").isNull(), "NO_PUBLISHED_RELEASE"),
        (~known_at(known_on), "NOT_KNOWN_THEN"),
        (~range_resolved(), "RANGE_UNRESOLVED"),
        (range_resolved() & ~range_contains(valid_on), "OUTSIDE_RANGE"),
        (F.col("verified_on").isNull(), "NOT_VERIFIED"),
        (F.col("verified_on").isNotNull() & (F.col("reverify_on") <= known_on), "STALE"),
        (F.col("blocked").isNotNull(), "GRAVE_INCIDENT"),
        (~F.col("capability").isin(*critical), "UNDECLARED_CAPABILITY"),
    ]
    told_of = [(F.col("capability") == c, f, F.col(f"_told_{f}")) for c, names in critical.items() for f in names]
    uninformed = [F.when(mine & (state != "INFORMED"), F.concat(F.lit(f"FIELD_{f}_"), state)) for mine, f, state in told_of]
    unevaluated = [F.when(mine & state.isNull(), F.lit(f"FIELD_{f}_NOT_EVALUATED")) for mine, f, state in told_of]
    said = F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), name) for c, name in cases), *uninformed, *unevaluated)
    reasons = F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, ","))
    return joined.withColumn("reasons", reasons).drop("released", "blocked", *(c for c in told.columns if c != "version_id"))


def told_states(evaluations: DataFrame, critical: dict[str, tuple[str, ...]]) -> DataFrame:
    """version_id and _told_f of each critical field f: the last state by name of its evaluations, null if there is none. One aggregate."""
    fields = sorted({f for names in critical.values() for f in names})
    states = (F.max(F.when(F.col("field") == f, F.col("state"))).alias(f"_told_{f}") for f in fields)
    return evaluations.filter(F.col("field").isin(*fields)).groupBy("version_id").agg(*states)


def servable(versions: DataFrame, releases: DataFrame, incidents: DataFrame, evaluations: DataFrame, valid_on: Column, known_on: Column, critical: dict[str, tuple[str, ...]]) -> DataFrame:
    """The versions that with_reasons() finds no reason against. What a version itself tells is asked before anything is joined."""
    fresh = F.col("verified_on").isNotNull() & F.coalesce(F.col("reverify_on") > known_on, F.lit(True))
    own = versions.filter((F.col("review_state") == "PUBLISHED") & known_at(known_on) & range_contains(valid_on) & fresh & F.col("capability").isin(*critical))
    live = own.join(releases.filter("state = 'PUBLISHED'").select("release_no"), "release_no", "left_semi").join(grave_open(incidents), "version_id", "left_anti")
    told = told_states(evaluations, critical)
    joined = live.join(told, "version_id", "left")
    informed = F.lit(True)
    for c, names in critical.items():
        for f in names:
            informed = informed & ((F.col("capability") != c) | F.coalesce(F.col(f"_told_{f}") == "INFORMED", F.lit(False)))
    return joined.filter(informed).select(*versions.columns)


def periods(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """From dated values to periods: each holds until the day before the next one; the last stays open."""
    w = Window.partitionBy(key).orderBy(day)
    return rows.withColumn("valid_from", F.col(day)).withColumn("valid_to", F.date_sub(F.lead(day).over(w), 1)).select(key, value, "valid_from", "valid_to")


def as_of(rows: DataFrame, day: Column) -> DataFrame:
    """The periods that hold the day."""
    return rows.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def first_overlaps(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose closed range overlaps that of an earlier row of their key, by a running maximum of ends: no pairs are made."""
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    w = Window.partitionBy(*key).orderBy("valid_from", order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reached", F.max(end).over(w)).filter(F.col("reached") >= F.col("valid_from"))


def best_state(state: str, order: tuple[str, ...]) -> Column:
    """The best of a group's states by an explicit order, best first; states outside it count as the last."""
    rank = F.lit(len(order) - 1)
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col(state) == s, i).otherwise(rank)
    names = F.array(*map(F.lit, order))
    return names[F.min(rank)]
