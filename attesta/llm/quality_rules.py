"""Quality rules by host: base failures of documents, host rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import durable, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: A host is refused if more than this share of its documents fails, even SURE deviations below its shrunk rate.
HOST_LIMIT, SURE = 0.3, 2.33
#: Documents by which a host counts in the prior at most.
WEIGHT = 100
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of MEASURES for one whole text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            reach = 0
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + WINDOW - max(reach, i)
                    reach = i + WINDOW
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", mark: Column | None = None) -> DataFrame:
    """doc_id, host, mark, the five counts and base_failed, one row per input row. Null text: no words, which fails."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("mark", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 8 << 20):
                found = [measure(t) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("host"), batch.column("m"), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], schema=schema)

    kinds = "doc_id long, host string, mark long, " + ", ".join(f"{m} long" for m in MEASURES)
    marked = (F.lit(None) if mark is None else mark).cast("long").alias("m")
    counted = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(host).cast("string").alias("host"), marked).mapInArrow(run, kinds)
    return counted.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate and low: failures over documents, shrunk by a beta prior fitted to all hosts by moments, and the
    lower bound of that rate, SURE posterior deviations below it.

    Rows are summed before the shuffle, so one host may hold any share of them. A host counts in the prior by its
    documents, up to WEIGHT, so that a large host doesn't set it alone. Mean m is that of the hosts' rates; their variance less what
    drawing n documents adds to it, m(1-m)/n, is v; strength m(1-m)/v - 1, between 1 and 1000. Null hosts are one host. No
    rows: no hosts.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    each = hosts.selectExpr("n", "failed / n p", f"least(n, {WEIGHT}) w")
    sums = each.selectExpr("sum(w * p) / sum(w) m", "sum(w * p * p) / sum(w) sq", "sum(w / n) / sum(w) noise")
    prior = sums.selectExpr("m", "greatest(sq - m * m - m * (1 - m) * noise, 1e-9) v").selectExpr("m", "least(greatest(m * (1 - m) / v - 1, 1D), 1000D) strength").first()
    m, strength = (prior["m"] or 0.0, prior["strength"] or 1.0) if prior else (0.0, 1.0)
    shrunk = hosts.withColumn("rate", (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))
    return shrunk.withColumn("low", F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1))))


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", limit: float = HOST_LIMIT, mark: Column | None = None) -> DataFrame:
    """Per document: the measures, base_failed, its host's shrunk failure rate, host_refused and kept.

    kept is false if the document fails the base rules or its host is refused: even the lower bound of the host's rate is over
    `limit`. Nulls: no text fails; null hosts are judged together; a null id is a document like others. Repeated rows are kept apart; other
    columns are dropped; `mark`, a whole number of each row, comes out as a column of that name. The measures are written once to the shared folder. A host's verdict is one row, joined back by host, where
    Spark may split a hot one.
    """
    measured = durable(measures(docs, text, key, host, mark))
    hosts = host_rates(measured).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), (F.col("low") > limit).alias("host_refused"))
    return (
        measured.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left")
        .drop("of", *(["mark"] if mark is None else []))
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_refused", F.lit(False)))
    )
