"""Rules under three-valued logic, release gates, business-day deadlines and unit diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.shared import durable


def all_of(*parts: Column) -> Column:
    """Kleene conjunction: false wins over unknown."""
    return reduce(Column.__and__, parts)


def any_of(*parts: Column) -> Column:
    """Kleene disjunction: true wins over unknown."""
    return reduce(Column.__or__, parts)


def missing(**facts: Column) -> Column:
    """The names of the facts that are null, in order."""
    return F.filter(F.array(*(F.when(v.isNull(), F.lit(n)) for n, v in facts.items())), lambda x: x.isNotNull())


def verdict(applies: Column, excluded: Column, lifted: Column, executable: Column) -> Column:
    """A rule that can't run needs review; then missing data; then a blocker that no exception lifts; else it can be had."""
    blocked = any_of(~applies, excluded)
    open_ = all_of(blocked, ~lifted)
    return F.when(~executable, "NEEDS_REVIEW").when(open_.isNull(), "NEEDS_DATA").when(open_, "BLOCKED").otherwise("AVAILABLE")


def gates(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """gate, failures: for each named check, how many rows break it; one scan for all."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("failures")) for n in checks))
    return counts.select(F.inline(pairs))


def business_days(days: DataFrame, day: str) -> DataFrame:
    """Each day of a calendar with `open` and `nth`, the running number of working days up to it. A calendar is bounded: a row a day."""
    working = F.weekday(day) < 5
    year = Window.partitionBy(F.lit(0)).orderBy(day)
    return days.withColumn("open", working).withColumn("nth", F.sum(working.cast("long")).over(year))


def deadline(rows: DataFrame, start: str, n: Column, calendar: DataFrame, day: str) -> DataFrame:
    """rows plus `due`, the n-th working day after start; null where the calendar doesn't reach that far. Two joins, no stepping."""
    at = calendar.select(F.col(day).alias(start), F.col("nth").alias("_from"))
    to = calendar.filter("open").select(F.col("nth").alias("_to"), F.col(day).alias("due"))
    placed = rows.join(at, start, "left").withColumn("_to", F.col("_from") + n)
    return placed.join(to, "_to", "left").drop("_to", "_from")


def unit_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, place, change between two versions' units (key, place, unit), whose places are unique within a key.

    Units that stayed in place are SAME and settled first. Of the rest, equal units pair by their turn among equals and are MOVED (reported
    at the new place); what is left in the same place on both sides is MODIFIED; what then remains is REMOVED or ADDED. Nothing is compared
    beyond its own key, and every step is an aggregation, so null keys and units meet like any others.

    The sides are met once and written: the steps that follow start from a table, not each from a union of its own, whose rows Spark 4.1
    takes to be dealt by the key already where both sides come from shuffled joins, and then leaves unpaired.
    """
    sides = old.select(*key, "place", "unit", F.lit(True).alias("old")).unionByName(new.select(*key, "place", "unit", F.lit(False).alias("old")))
    had, has = F.bool_or("old"), F.bool_or(~F.col("old"))
    placed = durable(sides.groupBy(*key, "place", "unit").agg(had.alias("had"), has.alias("has")))
    same = placed.filter("had and has").select(*key, "place", F.lit("SAME").alias("change"))
    turn = F.row_number().over(Window.partitionBy(*key, "unit", "had").orderBy("place"))
    apart = placed.filter("not (had and has)").withColumn("turn", turn)
    was, now = F.min(F.when(F.col("had"), F.col("place"))), F.min(F.when(F.col("has"), F.col("place")))
    paired = apart.groupBy(*key, "unit", "turn").agg(was.alias("was"), now.alias("now"))
    moved = paired.filter("was is not null and now is not null").select(*key, F.col("now").alias("place"), F.lit("MOVED").alias("change"))
    rest = paired.filter("was is null or now is null").select(*key, F.coalesce("was", "now").alias("place"), F.col("was").isNotNull().alias("old"))
    change = F.when(had & has, "MODIFIED").when(had, "REMOVED").otherwise("ADDED")
    return same.unionByName(moved).unionByName(rest.groupBy(*key, "place").agg(change.alias("change")))
