"""Modes of answers, next steps, completed identities and redirected citations on small cases."""

from attesta.operators import answers as A
from attesta.operators import identity as I


def test_modes_and_extracts(spark):
    queries = spark.createDataFrame([(1, "d", "VALID"), (2, "d", "FOREIGN_LINK"), (3, None, None), (4, "d", "VALID"), (5, "d", None), (6, None, "VALID")], "query_id int, draft string, fault string")
    rows = [(q, p, c, a, u, t) for q in (1, 2, 3, 5) for p, c, a, u, t in ((2, 7, "Ley 1", "art. 2", " two "), (1, 9, "Ley 1", None, None), (2, 8, "Ley 2", "art. 3", "x"))] + [(9, 1, 1, "Ley", None, "x")]
    fragments = spark.createDataFrame(rows, "query_id int, place int, chunk_id int, act string, unit string, text string")
    got = {r.query_id: (r.mode, r.reason, r.answer, r.cites) for r in A.answers(queries, fragments, 2).collect()}
    extract = "**Ley 1** [[chunk:9]]\n\n\n\n---\n\n**Ley 1, art. 2** [[chunk:7]]\n\ntwo"
    assert got == {
        1: ("WRITTEN", None, "d", ["9", "7"]), 2: ("EXTRACT", "DRAFT_REFUSED", extract, ["9", "7"]), 3: ("EXTRACT", None, extract, ["9", "7"]), 4: ("ABSTAINED", "NO_EVIDENCE", None, []),
        5: ("EXTRACT", "DRAFT_REFUSED", extract, ["9", "7"]), 6: ("ABSTAINED", "NO_EVIDENCE", None, []),
    }
    assert {r.mode for r in A.answers(queries, fragments.limit(0), 2).collect()} == {"ABSTAINED"}


def test_next_steps_go_from_the_question_to_the_procedure(spark):
    ways = "array<struct<blocker:string,exception:string,state:string>>"
    rows = [(1, "b", ["q", "r"], [("x", "e1", "UNKNOWN"), ("x", "e2", "FALSE"), ("y", None, None), ("z", "e3", "UNKNOWN")]), (2, "b", [], []), (3, "c", [], [])]
    verdicts = spark.createDataFrame(rows, f"person int, benefit string, questions array<string>, remedies {ways}")
    procedures = spark.createDataFrame([("b", "T", 2, "go", "PUBLISHED"), ("b", "T", 1, "ask", "PUBLISHED"), ("b", "S", 9, "no", "CANDIDATE")], "benefit string, title string, step_no int, step string, review string")
    got = sorted((r.person, r.place, r.origin, r.step) for r in A.next_steps(verdicts, procedures).collect())
    assert got == [
        (1, 1, "QUESTION", "q"), (1, 2, "EXCEPTION", "e1"), (1, 3, "EXCEPTION", "e3"), (1, 4, "PROCEDURE", "ask"), (1, 5, "PROCEDURE", "go"), (2, 1, "PROCEDURE", "ask"), (2, 2, "PROCEDURE", "go"),
    ]
    assert A.next_steps(verdicts, procedures.limit(0)).count() == 3


def test_identities_are_completed_and_never_overwritten(spark):
    acts = [(1, None, None, None, "t", True), (2, "LEY", "5", 1999, "t", False), (3, "LEY", "5", 1999, "t", False), (4, None, "7", None, "t", True), (5, "LEY", None, None, "t", True), (6, None, "1", 2000, "t", False)]
    views = [(1, 2, "LEY", "9", 2001, "late"), (1, 1, "LEY", "8", 2001, ""), (1, 0, "LEY", "", 2001, "part"), (2, 1, "LEY", "5", 1999, "new"), (3, 1, "LEY", "5", 1999, "x"), (3, 2, "LEY", "6", 1999, "x"), (4, 1, "LEY", "7", None, "x"), (6, 1, "LEY", "1", 2000, "x"), (9, 1, "LEY", "1", 2000, "x")]
    schema = "type string, number string, year int, title string"
    got = I.completed(spark.createDataFrame(acts, f"norm_id int, {schema}, uncertain boolean"), spark.createDataFrame(views, f"norm_id int, place int, {schema}")).collect()
    assert {r.norm_id: tuple(r)[1:] for r in got} == {
        1: ("LEY", "8", 2001, "t", False, "COMPLETED"), 2: ("LEY", "5", 1999, "t", False, "KEPT"), 3: ("LEY", "5", 1999, "t", False, "CONFLICT"),
        4: (None, "7", None, "t", True, "KEPT"), 5: ("LEY", None, None, "t", True, "KEPT"), 6: (None, "1", 2000, "t", False, "CONFLICT"),
    }


def test_only_approved_equivalences_lead_on(spark):
    rows = [("a", "MOVED", "t-1/article-1/item-a", "t-1/article-2/item-a"), ("a", "MOVED", "article-3/item-a", "article-3/item-b"), ("a", "MODIFIED", "article-4", None), ("a", "REMOVED", "article-5", None), ("a", "ADDED", None, "article-6"), ("b", "MOVED", "preamble", "article-1")]
    found = I.equivalences(spark.createDataFrame(rows, "key string, change string, was_route string, now_route string"))
    assert sorted(tuple(r)[1:] for r in found.collect()) == [
        ("article-3/item-a", "article-3/item-b", "RENUMBERED", False), ("article-4", "article-4", "REPLACED", False), ("preamble", "article-1", "RENUMBERED", True), ("t-1/article-1/item-a", "t-1/article-2/item-a", "RENUMBERED", True),
    ]
    known = spark.createDataFrame([("a", "r1", "s1", "APPROVED"), ("a", "r2", "s2", "CANDIDATE"), ("a", "r3", "s3", "PUBLISHED"), ("a", "r3", "s4", "APPROVED"), ("a", "r4", "s5", "PUBLISHED"), ("a", "r4", "s5", "APPROVED")], "key string, from_route string, to_route string, review string")
    cites = spark.createDataFrame([(i, "a", f"r{i}") for i in range(1, 6)] + [(9, "b", "r1"), (10, None, "r1")], "cite_id int, key string, route string")
    assert {r.cite_id: r.now for r in I.redirected(cites, known).collect()} == {1: "s1", 2: None, 3: None, 4: "s5", 5: None, 9: None, 10: None}
