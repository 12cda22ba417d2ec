"""Audit of how filters interact: documents' flags are replayed under every order of the filters, step by step."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Texts that at least this many documents share, and more than one in HOT of all documents, are hot; so there are at most HOT hot texts.
HOT_FROM, HOT = 1000, 1000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides. Null: the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with `copy`: whether a row with a smaller doc_id has the same digest. Null ids are never copies and make none.

    The smallest id of each repeated digest is found by a sum before the shuffle. Hot digests, at most HOT of them, are broadcast, so
    that their rows stay where they are; the others are joined by digest.
    """
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_"), F.count("*").alias("n_")).filter("n_ > 1")
    groups = durable(groups)
    hot_from = max(HOT_FROM, rows.count() // HOT)
    hot = F.broadcast(groups.filter(F.col("n_") > hot_from).select("digest", F.col("first_").alias("hot_")))
    marked = rows.join(hot, "digest", "left")
    cold = marked.filter("hot_ is null").drop("hot_").join(groups.filter(F.col("n_") <= hot_from).drop("n_"), "digest", "left")
    found = cold.unionByName(marked.filter("hot_ is not null").withColumnRenamed("hot_", "first_"))
    return found.withColumn("copy", F.coalesce(F.col("first_") < F.col("doc_id"), F.lit(False))).drop("first_")


def flags(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """Per document: doc_id, part, fails (a bit for each of the filters A to E, A the lowest), good and toxic.

    E fails if a smaller doc_id has the same text, by sha256. Null text: empty; null part: the empty string, and its rows count with
    those that have it; null keys have no label and are no copies. A key with several labels is good (toxic) if one says so;
    null labels say nothing. Each of repeated rows counts. Whole texts are read once; what moves is a digest and flags.
    """
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_failures(F.col(text)).values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = durable(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("fails"), digest.alias("digest")))
    told = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id"))
    told = told.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    found = later_copies(rows)
    found = found.select("doc_id", "part", (F.col("fails") + F.when(F.col("copy"), F.lit(16)).otherwise(F.lit(0))).alias("fails"))
    joined = found.filter("doc_id is not null").join(told, "doc_id", "left").unionByName(found.filter("doc_id is null"), allowMissingColumns=True)
    return joined.select("doc_id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(flagged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Per part, order of the filters and step: the counts of COUNTS and shapley, the documents that the step's filter removes over all orders.

    Every document's flags meet every order (a broadcast of as many rows as filters have orders, 120 for five) and every step of it;
    the first filter of an order that it fails removes it. All counts are sums over conditions, added up before rows move, so parts may
    be of any size; steps that remove nothing count 0. No documents: no rows.
    """
    n = len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    orders = [(i, "".join(o), *(bit[f] for f in o), [(k, bit[f]) for k, f in enumerate(o, 1)]) for i, o in enumerate(permutations(filters))]
    kinds = "number int, filter_order string, " + "".join(f"bit{k} int, " for k in range(1, n + 1)) + "steps array<struct<step: int, bit: int>>"
    known = flagged.sparkSession.createDataFrame(orders, kinds)
    met = flagged.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(known.drop("filter_order")))
    first = F.lit(n + 1)
    for k in range(n, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"bit{k}")) != 0, F.lit(k)).otherwise(first)
    steps = met.select("part", "number", "fails", "good", "toxic", first.alias("first"), F.inline("steps"))
    here = F.col("first") == F.col("step")
    conditions = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": (F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    counted = steps.groupBy("part", "number", "step", "bit").agg(*(F.count_if(conditions[c]).alias(c) for c in COUNTS))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    named = counted.withColumn("shapley", shapley).join(F.broadcast(known.select("number", "filter_order")), "number")
    return named.select("part", "filter_order", "step", *COUNTS, "shapley")
