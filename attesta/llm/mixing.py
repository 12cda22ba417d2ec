"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, quotas per shard, seeded choice of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import durable, placed

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the mix's size over that of all documents; times that a word is taken at most.
WEIGHTS, SHARE, TIMES = (5, 2, 1), 1.5, 2
#: Words of a block; words and documents of a shard, about.
BLOCK, SHARD, SHARD_ROWS = 8, 1 << 18, 1 << 16
SEED = 11
PIECE = "struct<first: long, words: long, times: int>"


def water_level(sources: DataFrame, share: float, times: int) -> float:
    """The words that a weight of 1 gets, if sources (weight, source_size) share `share` of all sizes and none gets more than
    `times` its size. Each round holds the sources that the level would overfill at their limit and shares the rest anew; the held
    ones only grow, so rounds end, after as many as there are sources at most. A round is one sum over one row a source."""
    level, before = float("inf"), -1
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.lit(float(times)) * F.col("source_size") <= F.col("weight") * F.lit(level) if before >= 0 else F.lit(False)
        held, weight, n = sources.agg(F.sum(F.when(full, F.lit(times) * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == before or not weight:
            return level
        level, before = (total - (held or 0)) / weight, n


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """sources (source, source_size) with `number` (their place by code point, null last), `weight` and `target`. One row a source."""
    numbered = placed(sources, F.col("source").asc_nulls_last()).withColumnRenamed("place", "number")
    turn = F.pmod("number", F.lit(len(weights))).cast("int") + 1
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    most = F.lit(float(times)) * F.col("source_size")
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(water_level(weighed, share, times)), most))


def apportion(rows: DataFrame, group: str, key: str, votes: str = "votes", seats: str = "seats") -> DataFrame:
    """group, key and `quota`: each group's seats go to its keys by the highest quotients votes / (seats held + 1/2).

    With n keys and V votes, a divisor of V / (seats - n/2) gives away no more than all seats, and one of V / (seats + n/2) no less. So
    seats above the first are sure; only quotients between the two, about 2n in all, are sorted, in ranges, and the highest ones get
    the seats that are left. Ties go to the smaller key. votes are above 0; seats are the same in a group.
    """
    n, v, s = F.col("n_"), F.col("v_"), F.col(seats)
    sums = rows.groupBy(group).agg(F.count("*").alias("n_"), F.sum(votes).alias("v_"), F.max(votes).alias("most_"))
    high = F.when(s > n / 2, v / (s - n / 2) * (1 + 1e-9)).otherwise(F.col("most_") * 2 + 1)
    low = v / (s + n / 2) * (1 - 1e-9)
    bounds = rows.join(sums, group).withColumn("sure", F.floor(F.col(votes) / high + 0.5)).withColumn("open", F.floor(F.col(votes) / low + 0.5))
    bounds = durable(bounds.select(group, key, votes, seats, "sure", "open"))
    contested = bounds.filter("open > sure").select(group, key, F.col(votes).alias("votes_"), F.explode(F.sequence("sure", F.col("open") - 1)).alias("held"))
    order = placed(contested.withColumn("quotient", F.col("votes_") / (F.col("held") + 0.5)), F.col(group), F.desc("quotient"), F.col(key), F.col("held"))
    left = bounds.groupBy(group).agg((F.max(seats) - F.sum("sure")).alias("left"))
    firsts = order.groupBy(group).agg(F.min("place").alias("first_")).join(left, group)
    won = order.join(firsts, group).filter(F.col("place") - F.col("first_") < F.col("left")).groupBy(group, key).agg(F.count("*").alias("won"))
    return bounds.join(won, [group, key], "left").select(group, key, (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("quota"))


def pieces_of(table: pa.Table) -> pa.Table:
    """The pieces of one shard's documents. Documents follow each other by their hashes and are cut into blocks, whose sizes differ by
    a word at most. Every block is taken quota // blocks times, and as many as are left over once more, chosen by the shard's seed."""
    table = table.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    ends = np.cumsum(table.column("size").to_numpy())
    starts, total = ends - table.column("size").to_numpy(), int(ends[-1])
    blocks, quota, number, shard = (table.column(c)[0].as_py() for c in ("blocks", "quota", "number", "shard"))
    times = np.full(blocks, quota // blocks, np.int32)
    times[np.random.default_rng([SEED, number, shard]).choice(blocks, quota % blocks, replace=False)] += 1
    edges = np.arange(blocks + 1) * total // blocks
    change = np.flatnonzero(np.diff(times)) + 1
    cuts = np.union1d(np.concatenate([[0], edges[change]]), starts)
    taken = times[np.searchsorted(edges, cuts, side="right") - 1]
    until = np.append(cuts[1:], total)
    doc = np.searchsorted(starts, cuts, side="right") - 1
    some = taken > 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[some], minlength=len(starts)))]).astype(np.int32)
    kinds = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("times", pa.int32())])
    parts = pa.StructArray.from_arrays([pa.array((cuts - starts[doc])[some]), pa.array((until - cuts)[some]), pa.array(taken[some])], fields=list(kinds))
    out = table.select(["doc_id", "source", "size", "source_size", "target"])
    return out.append_column("pieces", pa.ListArray.from_arrays(pa.array(offsets), parts))


def mix(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES,
    block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target (of its source) and pieces: runs of words, from `first` on, and
    how many times each is taken. A word that no piece holds isn't taken.

    Sources get targets by weight; sources below their limit get whole blocks of about `block` words by the highest quotients, those at
    it all their blocks `times` times; each source's blocks go to its shards, again by quotients. Shards are hash groups of a
    source's documents, as many as its words and documents ask for, so a hot source is many groups. Only sizes and hashes move,
    no texts. The same rows give the same pieces, whatever their order and partitions.

    Null text: size 0, no pieces; documents without words likewise. Null sources are one source, the last. Null keys are documents like
    others. Repeated rows are documents of their own; which of them gets which pieces doesn't matter, as they are alike. Empty tables
    give no rows. Other columns are dropped, whatever their names.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(SEED), F.col(key), F.col(text))
    sized = durable(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), h.alias("h")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = durable(with_targets(sums, weights, share, times))
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("docs") / SHARD_ROWS), F.lit(1))
    known = sources.select(F.col("source").alias("of"), "number", "source_size", "target", shards.alias("shards"))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("shard", F.pmod("h", "shards")).drop("of", "shards")
    filled = rows.filter("size > 0")

    blocks = F.greatest(F.lit(1), F.round(F.sum("size") / block)).cast("long")
    cut = durable(filled.groupBy("number", "shard").agg(blocks.alias("blocks"), F.max("target").alias("target"), F.max("source_size").alias("source_size")))
    whole = cut.groupBy("number").agg(F.sum("blocks").alias("blocks"), F.max("target").alias("target"), F.max("source_size").alias("source_size"))
    whole = durable(whole.select("number", "blocks", (F.col("target") / F.col("source_size") * F.col("blocks")).alias("votes"), (F.col("target") >= times * F.col("source_size")).alias("full")))
    part = whole.filter("not full and votes > 0")
    part = part.crossJoin(F.broadcast(part.agg(F.round(F.sum("votes")).cast("long").alias("seats")))).withColumn("all", F.lit(0))
    won = apportion(part, "all", "number").select("number", "quota")
    limit: Column = F.lit(times) * F.col("blocks")
    quotas = whole.join(won, "number", "left").select("number", F.when(F.col("full"), limit).otherwise(F.least(F.coalesce("quota", F.lit(0)), limit)).alias("seats"))
    votes = cut.select("number", "shard", "blocks", F.col("blocks").cast("double").alias("votes")).join(quotas, "number")
    dealt = apportion(votes, "number", "shard").join(cut.select("number", "shard", "blocks"), ["number", "shard"])
    dealt = dealt.withColumn("quota", F.least("quota", limit))

    kinds = f"doc_id long, source string, size long, source_size long, target double, pieces array<{PIECE}>"
    found = filled.join(dealt, ["number", "shard"]).groupBy("number", "shard").applyInArrow(pieces_of, kinds)
    empty = rows.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.expr(f"cast(array() as array<{PIECE}>)").alias("pieces"))
    return found.unionByName(empty)


def taken(pieces: Column) -> Column:
    """Words that pieces take, repeats counted."""
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + p["words"] * p["times"])


def cut_text(text: Column, pieces: Column) -> Column:
    """The texts of pieces: their words joined by spaces, as often as they are taken."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.flatten(F.transform(pieces, lambda p: F.array_repeat(F.array_join(F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")), " "), p["times"])))
