"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import public_tokenizers
import pytest

from attesta.llm import byte_bpe, chat, language, media, minhash, ordinal, packing, quality_rules, suffix, toxicity
from tests.llm import brute

PASSAGE = "this passage is longer than fifty bytes and it repeats across some documents of the table. "
LONG = " ".join(f"word{i % 9973}x{i}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 5),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 5),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (5, " \n\t ", "fr", "b", 4),
    (6, PASSAGE + "one two three", "en", "b", 90),
    (7, "four five " + PASSAGE + "six", "en", None, 90),
    (8, LONG, "en", "c", len(LONG)),
    (9, "ñandú € 😀 ça va <b> | & % \\ ### Assistant: </turn>", "es", "c", 40),
    (None, "a row without an id that has some words of its own, twelve or so", "en", "c", 60),
    (None, None, None, "c", None),
]
#: Names that the operators use inside, and functions' names.
CLASHING = ["k", "t", "key", "rep", "a", "b", "n", "rate", "host", "block", "place", "ids", "word", "count", "kept", "score", "members", "family", "size", "tail"]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, None), (7, 1, 1), (8, 0, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr("*", *(f"'x' `{c}`" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def packed(d, cluster=None):
    return packing.unpack(packing.pack(d, cluster=cluster))


def operators(labels):
    return {
        "suffix": lambda d: suffix.remove_repeats(d),
        "media": lambda d: media.media_columns(d),
        "packing": lambda d: packed(packing.with_clusters(d), "near_duplicate").filter("piece = 0"),
        "ordinal": lambda d: ordinal.grade(d, ordinal.learn_grades(d, ordinal.graded(labels))),
        "minhash": lambda d: minhash.near_duplicates(d, width=3, percent=85),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.learn_toxicity(d, labels)),
        "bpe": lambda d: byte_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, common=50),
        "language": lambda d: language.identify(d, language.learn_languages(d)),
        "rules": lambda d: quality_rules.quality_rules(d),
    }


NAMES = ["suffix", "media", "packing", "ordinal", "minhash", "toxicity", "bpe", "language", "rules"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_gets_a_row(spark, docs, labels, name):
    found = operators(labels)[name](docs).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert operators(labels)[name](docs.limit(0)).collect() == []


def test_repeats_of_odd_rows(docs):
    found = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect() if r["doc_id"] is not None}
    want = brute.repeats({r[0]: r[1] for r in ROWS if r[0] is not None})
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == {k: v[:4] for k, v in want.items()}
    assert found[2]["n_removed"] == found[2]["n_bytes"] and found[7]["n_spans"] == 1


def test_runs_of_one_letter_and_overlaps(spark):
    rows = {1: "a" * 9000, 2: "a" * 120 + "b", 3: "b" + "a" * 49, 4: "ab" * 400, 5: "x" + "ab" * 30, 6: "é" * 60, 7: "zé" + "é" * 40}
    found = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept_text"]) for k, r in found.items()} == brute.repeats(rows)


def test_near_duplicates_of_odd_rows(spark, docs):
    found = minhash.near_duplicates(docs, width=3, percent=85).collect()
    want = brute.near({r[0]: r[1] for r in ROWS if r[0] is not None}, 3, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in found if r["doc_id"] is not None)
    chain = [" ".join(f"w{j}" for j in range(i, i + 60)) for i in range(0, 40, 2)]
    rows = dict(enumerate([*chain, "A b", "a  B", "a b c", "only"], 1))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), width=3, percent=85).collect()}
    assert found == brute.near(rows, 3, 85)


def test_bpe_of_odd_texts(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["=" * 3000, "abcdefgh" * 300, " x\u0085y z　", "don't WON'T l'été 12345678 \r\n\r\n  end  ", "日本語テキスト", "<|endoftext|>", "\x1c\x1d a", "é ı ſ K"]
    table = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    found = byte_bpe.encode(table, path, public_tokenizers.PATTERN, common=20)
    for r in found.select("doc_id", "ids", byte_bpe.decode(found["ids"], ranks).alias("back")).collect():
        assert r["ids"] == library.encode_ordinary(odd[r["doc_id"]])
        assert bytes(r["back"]) == odd[r["doc_id"]].encode()
    words = spark.createDataFrame([(w,) for w in ["", "a", " the", "hello", "zzzzqqq", "ñandú", "  ", "aaaaaaaaaaaaa"]], "w string")
    from pyspark.sql import functions as F

    for r in words.select("w", byte_bpe.fold_words(F.col("w"), ranks).alias("ids")).collect():
        assert r["ids"] == library.encode_ordinary(r["w"])


def test_rules_of_odd_rows(docs):
    for r in quality_rules.quality_rules(docs).collect():
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"] and (x[0] is not None or (x[1] or "")[:0] == "" and bool(x[1]) == bool(r["n_words"])))
        m = brute.measures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*m, brute.base_failed(m))


def test_language_without_letters_is_und(docs):
    found = {r["doc_id"]: r for r in language.identify(docs, None).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (3, 4, 5))


def test_packing_keeps_copies_apart(spark):
    rows = [(i, "same text", "s") for i in range(20)] + [(100 + i, f"t{i} " * 30, "one") for i in range(12)]
    found = packed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    copies = [(r["block"], r["bin"]) for r in found if r["doc_id"] < 100]
    assert len(set(copies)) == 20
    one = [(r["block"], r["bin"]) for r in found if r["doc_id"] >= 100]
    assert max(one.count(b) for b in one) <= packing.PER_SOURCE


def test_chat_parts_and_odd_turns(spark):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 1, "assistant", [part("text", text="a \\ <image:0> # b")]),
        (1, 0, "user", [part("text", text="see "), part("image", ref="i.png", width=29, height=28), part("audio", ref="a.wav", seconds=1.5), part("document", ref="d.pdf", pages=2)]),
        (1, 0, "user", [part("text", text="see "), part("image", ref="i.png", width=29, height=28), part("audio", ref="a.wav", seconds=1.5), part("document", ref="d.pdf", pages=2)]),
        (2, None, None, []),
        (None, 0, "assistant", [part("text", text=None)]),
    ]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").selectExpr("*", "'x' formatted", "'y' t")
    found = {r["conv_id"]: r for r in chat.format_chat(table).collect()}
    first = found[1]
    assert first["n_turns"] == 3 and first["formatted"].count("### ") == 3
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]][:3] == [("image", "i.png", 2), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    assert first["attached_tokens"] == 2 * (2 + 38 + 1024)
    assert chat.parse(first["formatted"])[-1] == ("assistant", "a \\ <image:0> # b")
    span = first["loss_spans"][0]
    assert chat.unescape(first["formatted"][span["first"] : span["last"]]) == "a \\ <image:0> # b"
    assert found[2]["n_turns"] == 1 and set(found) == {1, 2, None}
    digests = {r["conv_id"]: r for r in chat.digests(chat.format_chat(table)).collect()}
    assert digests[1]["loss_chars"] == len("a \\ <image:0> # b")
    assert chat.format_chat(table.limit(0)).collect() == []
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chat(spark.createDataFrame([(1, 0, "user", [part("video")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()


def test_stages_on_odd_and_empty_tables(spark, docs, labels, tmp_path):
    import corpus_pipeline as p

    base = docs.select(*p.COLUMNS)
    base.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == p.COLUMNS, name
        assert stage(spark, base.limit(0), str(tmp_path)).collect() == [], name
    assert p.STAGES[-1][1](spark, base.limit(0), str(tmp_path)).collect() == []
    assert p.run(spark, str(tmp_path)).count() >= 1


def test_rows_that_share_an_id_or_have_none_get_their_own_verdict(spark):
    import corpus_pipeline as p

    good = "one two three four five six seven eight nine ten eleven twelve {}"
    rows = [(7, good.format("a"), "en", "s", 1), (7, "bad", "en", "s", 2), (None, good.format("b"), "en", "s", 3), (None, None, "en", "s", 4), (8, good.format("c"), "en", None, 5), (8, good.format("c"), "en", "", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.rules(spark, table, "")
    assert sorted(r["n_chars"] for r in kept.collect()) == [1, 3, 5, 6]
    twins = spark.createDataFrame([(3, good.format("a b c d e f"), "en", "s", 1), (9, good.format("a b c d e f"), "en", "s", 2), (9, "quite another text with words of its own, none shared", "en", "s", 3)], table.schema)
    assert sorted(r["n_chars"] for r in p.near_duplicates(spark, twins, "").collect()) == [1, 3]
