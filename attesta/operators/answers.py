"""What is answered and what comes next: the mode of an answer with its text, and the steps in the order that costs a person least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def extracts(fragments: DataFrame, most: int) -> DataFrame:
    """query_id, extract, cites: each query's first `most` fragments (query_id, place, chunk_id, act, unit, text) by place, as they stand, each
    under its act, its unit where it has one, and its citation. Equal places go by chunk_id, then by what the fragments say.

    Spark keeps the first rows of a window's groups before the shuffle already, so a query with many fragments sends few."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_id", "act", "unit", "text"))
    kept = fragments.withColumn("turn", turn).filter(F.col("turn") <= most)
    cite = F.concat(F.lit("[[chunk:"), F.col("chunk_id").cast("string"), F.lit("]]"))
    told = F.concat(F.lit("**"), F.concat_ws(", ", "act", "unit"), F.lit("** "), cite, F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))))
    held = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", told.alias("told"), F.col("chunk_id").cast("string").alias("cite")))).alias("f"))
    return held.select("query_id", F.array_join("f.told", SEPARATOR).alias("extract"), F.col("f.cite").alias("cites"))


def mode(has_evidence: Column, draft: Column, fault: Column) -> Column:
    """struct(mode, reason): ABSTAINED without evidence, whatever was drafted; EXTRACT without a draft or with one that isn't VALID; else WRITTEN."""
    kind = F.when(~has_evidence, "ABSTAINED").when(draft.isNull() | ~fault.eqNullSafe(F.lit("VALID")), "EXTRACT").otherwise("WRITTEN")
    reason = F.when(~has_evidence, "NO_EVIDENCE").when((kind == "EXTRACT") & draft.isNotNull(), "DRAFT_REFUSED")
    return F.struct(kind.alias("mode"), reason.alias("reason"))


def answers(queries: DataFrame, fragments: DataFrame, most: int) -> DataFrame:
    """query_id, mode, reason, answer, cites for each of queries (query_id, draft, fault; query_id unique). An answer is the draft, the extract,
    or null; what was written is still cited by its fragments."""
    found = queries.join(extracts(fragments, most), "query_id", "left").withColumn("m", mode(F.col("cites").isNotNull(), F.col("draft"), F.col("fault")))
    answer = F.when(F.col("m.mode") == "WRITTEN", F.col("draft")).when(F.col("m.mode") == "EXTRACT", F.col("extract"))
    return found.select("query_id", "m.mode", "m.reason", answer.alias("answer"), F.coalesce("cites", F.array().cast("array<string>")).alias("cites"))


def next_steps(verdicts: DataFrame, procedures: DataFrame) -> DataFrame:
    """person, benefit, place, origin, step: first the next question, then each exception that is still undecided, then the steps that are
    published of the benefit's procedure.

    verdicts (person, benefit, questions, remedies) are those of rule_contract; procedures are (benefit, title, step_no, step, review). One
    that is known not to help is no step. Steps are sorted once a benefit, not once a person."""
    asked = F.when(F.size("questions") > 0, F.array(F.struct(F.lit("QUESTION").alias("origin"), F.col("questions")[0].alias("step")))).otherwise(F.array().cast("array<struct<origin:string,step:string>>"))
    open_ = F.filter("remedies", lambda r: r["state"] == "UNKNOWN")
    ways = F.transform(open_, lambda r: F.struct(F.lit("EXCEPTION").alias("origin"), r["exception"].alias("step")))
    told = F.array_sort(F.collect_list(F.struct("title", "step_no", "step")))
    steps = procedures.filter("review = 'PUBLISHED'").groupBy("benefit").agg(told.alias("p")).select("benefit", F.transform("p", lambda s: F.struct(F.lit("PROCEDURE").alias("origin"), s["step"].alias("step"))).alias("steps"))
    whole = verdicts.join(steps, "benefit", "left").withColumn("all", F.concat(asked, ways, F.coalesce("steps", F.array().cast("array<struct<origin:string,step:string>>"))))
    each = whole.select("person", "benefit", F.posexplode("all").alias("place", "s"))
    return each.select("person", "benefit", (F.col("place") + 1).alias("place"), "s.origin", "s.step")
