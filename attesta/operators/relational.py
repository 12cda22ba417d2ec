"""Relational operators that the queries share: optional filters, pages, places, top rows by key, percentiles, set differences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.shared import durable


def optional(**wanted) -> Column:
    """The conjunction of column = value over the values that are given; a value of None filters nothing."""
    return reduce(Column.__and__, (F.col(c) == v for c, v in wanted.items() if v is not None), F.lit(True))


def top_row(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by order, as one aggregate: no sort, and sums run before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def page(rows: DataFrame, order: list[Column], first: int, size: int) -> DataFrame:
    """Rows first + 1 to first + size by order, with the count of all rows. The count is a second job over the same filter;
    the page is a bounded top-k and never sorts everything."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(first).limit(size).join(F.broadcast(total), how="cross")


#: Parts that a key's span of values is cut into, at each of so many rounds, before values are counted one by one.
PARTS, ROUNDS = 1024, 2


def at_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key and a column for each of `ranks`: the value at that rank from 0 in order among the key's rows that have one, by the key's count n.

    No rows are sorted. Each round counts, by sums before the shuffle, the rows of equal parts of what is left of a key's span, and goes on
    with the part that holds the rank; after ROUNDS of them the distinct values of one part in PARTS ** ROUNDS are counted. So a key may hold
    any share of the rows. Keys and ranks are joined as rows, a few a key. Values are finite numbers; null keys are one key; keys without
    values are left out.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    spans = known.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    at = spans.select("_key", "low", "high", wanted.alias("w")).select("_key", "w.name", "w.rank", "low", "high", F.lit(0).cast("long").alias("under"))
    target = ["_key", "name", "rank", "low", "high", "under"]

    def counted(at: DataFrame, by: Column) -> DataFrame:
        """Of the values in each target's span, the group (by) that holds its rank: its bounds, and how many values are under it."""
        held = known.join(at.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("low"), F.col("high"))).drop("_k")
        groups = held.groupBy("_key", "name", "rank", "under", by.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        reached = F.sum("c").over(Window.partitionBy("_key", "name").orderBy("part"))
        found = groups.withColumn("reached", F.col("under") + reached).filter((F.col("reached") > F.col("rank")) & (F.col("reached") - F.col("c") <= F.col("rank")))
        return found.withColumn("under", F.col("reached") - F.col("c")).select(*target)

    width = (F.col("high") - F.col("low")) / PARTS
    for _ in range(ROUNDS):
        at = durable(counted(at, F.coalesce(F.least(F.floor(F.try_divide(F.col("_v") - F.col("low"), width)), F.lit(PARTS - 1)), F.lit(0))))
    exact = counted(at, F.col("_v"))
    columns = (F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks)
    return exact.groupBy(F.col("_key").alias(key)).agg(*columns)


def discrete_rank(p: str) -> Callable[[Column], Column]:
    """The rank from 0, in a group of n, of the exact discrete percentile: the first that at least the share p doesn't exceed."""
    return lambda n: F.greatest(F.ceil(F.lit(p).cast("decimal(6,4)") * n) - 1, F.lit(0))


def nearest_rank(p: str) -> Callable[[Column], Column]:
    """The rank from 0, in a group of n, that is nearest to the share p of the way from the first to the last."""
    return lambda n: F.floor(F.lit(p).cast("decimal(6,4)") * (n - 1) + F.lit("0.5").cast("decimal(2,1)"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """key columns and side for the keys of only one side."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    both = a.join(b, keys, "full")
    return both.filter("l is null or r is null").select(*keys, F.when(F.col("l").isNull(), "RIGHT").otherwise("LEFT").alias("side"))


def digests(rows: DataFrame, key: str, id_: str, span: int = 4096) -> DataFrame:
    """key, n, digest: the count and one SHA-256 of each key's set of whole-number ids, the same for equal sets only.

    Ids are hashed in ranges: the sorted ids of a span as "[1,2,3]", then the digests of a span of such ranges in the same way, then those of
    the key. So no task holds more than `span` ids or digests, but for the last, which holds a digest for each span * span ids.
    """
    listed = lambda column: F.sha2(F.concat(F.lit("["), F.array_join(column, ","), F.lit("]")), 256)
    ids = rows.select(key, F.col(id_).cast("long").alias("i")).filter("i is not null")
    ids = ids.groupBy(key, F.floor(F.col("i") / span).alias("a")).agg(F.array_sort(F.collect_set("i")).alias("ids"))
    level = ids.select(key, "a", F.size("ids").cast("long").alias("n"), listed(F.col("ids").cast("array<string>")).alias("digest"))
    for up in (F.floor(F.col("a") / span), F.lit(0)):
        inner = F.array_sort(F.collect_list(F.struct("a", "digest")))
        level = level.groupBy(key, up.alias("up")).agg(F.sum("n").alias("n"), inner.alias("inner")).select(key, F.col("up").alias("a"), "n", listed(F.col("inner.digest")).alias("digest"))
    return level.drop("a")


def severity_rank(column: str, order: tuple[str, ...]) -> Column:
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == s, i).otherwise(rank)
    return rank


def conciliation(rows: DataFrame, key: str, content: Column, accepted: Column, rejected: Column) -> DataFrame:
    """key, read, fresh, repeated, rejected, balanced: what a load of rows did with them.

    Of equal accepted contents one row is fresh and the others are repeated. A row that is neither accepted nor rejected (both unknown), or
    both, makes its key unbalanced. Equal contents are counted before they meet, so a common one is a row a task.
    """
    yes = F.count_if(F.coalesce(accepted, F.lit(False)))
    each = rows.withColumn("_content", content).groupBy(key, "_content").agg(F.count("*").alias("n"), yes.alias("a"), F.count_if(F.coalesce(rejected, F.lit(False))).alias("r"))
    sums = each.groupBy(key).agg(F.sum("n").alias("read"), F.count_if(F.col("a") > 0).alias("fresh"), F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("repeated"), F.sum("r").alias("rejected"))
    return sums.withColumn("balanced", F.col("read") == F.col("fresh") + F.col("repeated") + F.col("rejected"))
