"""Indicators of a dashboard: how many rows each has, and the first of them, from one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Indicator:
    """Rows that a number stands for, and the order in which they are shown. `alarming`: a greater number is bad news."""

    name: str
    rows: DataFrame
    order: tuple[Column, ...]
    alarming: bool = False


def measure(indicator: Indicator, most: int) -> tuple[int, list[str]]:
    """How many rows there are, and the first `most` of them as JSON. The limit cuts what is shown, never what is counted: rows are counted
    while the same job picks the first ones, of which each task sends `most` at most."""
    if most <= 0:
        return indicator.rows.count(), []
    seen = Observation(indicator.name)
    # the count stands before the order, so each row passes it; what is picked is sorted by the text last, so that ties don't matter
    told = indicator.rows.select("*", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_told")).observe(seen, F.count(F.lit(1)).alias("n"))
    first = told.orderBy(*indicator.order, "_told").select("_told").limit(most).collect()
    return seen.get["n"], [r["_told"] for r in first]


def dashboard(indicators: list[Indicator], most: int) -> DataFrame:
    """indicator, n, alarming, place, told: a row for each row that is shown, from place 1, and one without place for an indicator that shows none."""
    spark, found = indicators[0].rows.sparkSession, []
    for i in indicators:
        n, told = measure(i, most)
        found += [(i.name, n, i.alarming, place, t) for place, t in (enumerate(told, 1) if told else [(None, None)])]
    return spark.createDataFrame(found, "indicator string, n long, alarming boolean, place int, told string")


def counts(indicators: dict[str, Column], rows: DataFrame) -> DataFrame:
    """indicator, n of indicators that are conditions on one table: all numbers from one scan."""
    one = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in indicators.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("indicator"), F.col(k).alias("n")) for k in indicators))))
