"""The numbered queries on whole small tables, against brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from attesta.llm import queries as q
from attesta.llm.media import pair_codes, peaks
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(df):
    found = df.collect()
    return {r[0]: r for r in found}, len(found)


def test_repeats_match_brute_force(spark, small, docs):
    found, n = rows(q.op1_suffix_array(spark, small))
    want = brute.repeats(docs)
    assert n == len(docs)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == {k: v[:4] for k, v in want.items()}
    assert any(r["n_removed"] for r in found.values())


def test_media_round_trip(spark, small, docs):
    found, n = rows(q.op2_media(spark, small))
    assert n == len(docs)
    for k, t in docs.items():
        data = (t or "").encode()
        size = max(192, -(-len(data) // 192) * 192)
        payload = data.ljust(size, b" ")
        r = found[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), size, brute.sha(payload), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == r["payload_bytes"] + 44 + r["payload_bytes"] % 2
        pairs = np.array([r["peak_times"], r["peak_codes"]], np.int32)
        assert r["feature"] == f"{pairs.shape[1]}:{brute.sha(pairs.tobytes())}"
    for k in sorted(docs)[:40]:
        payload = (docs[k] or "").encode()[:9600].ljust(192, b" ")
        frames = peaks(payload[: len(payload) // 192 * 192])
        assert brute.peaks_fit(payload, frames)
        times, codes = pair_codes(frames)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == brute.peak_pairs(frames.tolist())


def test_chat_round_trip(spark, small):
    found, n = rows(q.op5_chat(spark, small))
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", said), ("assistant", said)]
    assert n == len(turns)
    for k, said in turns.items():
        loss = "".join(t for role, t in said if role == "assistant")
        r = found[k]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == brute.sha("".join(f"{a}\n{b}\n" for a, b in said).encode())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss.encode()))
        assert r["formatted_chars"] > sum(len(a) + len(b) for a, b in said)


def test_near_duplicates_match_brute_force(spark, small, docs):
    found, n = rows(q.op6_minhash(spark, small))
    want = brute.near(docs, 3, 85)
    assert n == len(docs)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())
    assert any(not r["kept"] for r in found.values())


def test_byte_bpe_matches_the_library(spark, small, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from attesta.llm.byte_bpe import read_ranks

    library = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    found, n = rows(q.op8_byte_bpe(spark, small))
    assert n == len(docs)
    for k, t in docs.items():
        ids = library.encode_ordinary(t or "")
        r = found[k]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((t or "").encode()))


def test_quality_rules_match_brute_force(spark, small):
    found, n = rows(q.op10_quality_rules(spark, small))
    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert n == len(table)
    failed, hosts = {}, {}
    for d in table:
        m = brute.measures(d["text"])
        r = found[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        failed[d["doc_id"]] = brute.base_failed(m)
        assert r["base_failed"] == failed[d["doc_id"]]
        hosts.setdefault(d["source"], []).append(failed[d["doc_id"]])
    rates = brute.host_rates({h: (len(x), sum(x)) for h, x in hosts.items()})
    for d in table:
        r = found[d["doc_id"]]
        rate, low = rates[d["source"]]
        assert r["host_rate"] == pytest.approx(rate)
        assert r["host_refused"] == (low > 0.3)
        assert r["kept"] == (not failed[d["doc_id"]] and low <= 0.3)


def test_a_bad_host_is_refused_and_others_stay(spark):
    from attesta.llm.quality_rules import quality_rules

    good = "one two three four five six seven eight nine ten eleven {}"
    sizes = {"big": (900, 30), "bad": (120, 90), "small bad": (6, 5), "plain": (200, 8), "other": (150, 3), None: (40, 1)}
    rows = [(1000 * i + k, "short" if k < failed else good.format(k), host) for i, (host, (n, failed)) in enumerate(sizes.items()) for k in range(n)]
    found = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = brute.host_rates(sizes)
    for r in found:
        rate, low = want[r["host"]]
        assert r["host_rate"] == pytest.approx(rate) and r["host_refused"] == (low > 0.3)
        assert r["kept"] == (not r["base_failed"] and not r["host_refused"])
    assert {r["host"] for r in found if r["host_refused"]} == {"bad"} | ({"small bad"} if want["small bad"][1] > 0.3 else set())
    assert sum(r["base_failed"] for r in found if r["host"] == "bad") == 90 and not any(r["kept"] for r in found if r["host"] == "bad")


def test_toxicity_finds_held_out_toxic_texts(spark, small):
    bigger = small.replace("sf0.001", "sf0.01")
    found, n = rows(q.op7_toxicity(spark, bigger))
    assert n == spark.read.parquet(f"{bigger}/documents.parquet").count()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{bigger}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    hit = [found[k]["predicted"] for k, y in truth.items() if y == 1 and k in found]
    false = [found[k]["predicted"] for k, y in truth.items() if y == 0 and k in found]
    print("toxic recall", np.mean(hit), len(hit), "false positives", np.mean(false), len(false))
    assert np.mean(hit) >= 0.6  # a thousand texts hold 37 toxic ones to learn from; fifty thousand give 1.0
    assert np.mean(false) <= 0.05


def test_language_is_right_on_held_out_texts(spark, small):
    bigger = small.replace("sf0.001", "sf0.01")
    found, n = rows(q.op9_language(spark, bigger))
    table = spark.read.parquet(f"{bigger}/documents.parquet").collect()
    assert n == len(table)
    right, seen = 0, 0
    for d in table:
        r = found[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        letters = any(c.isalpha() for c in d["text"] or "")
        assert letters or r["lang_pred"] == "und"
        if r["held_out"] and d["lang"] and letters:
            right, seen = right + (r["lang_pred"] == d["lang"]), seen + 1
    print("held-out accuracy", right / seen, seen)
    assert right / seen >= 0.95


def test_quality_grades_rank_held_out_texts(spark, small):
    bigger = small.replace("sf0.001", "sf0.01")
    found, n = rows(q.op4_ordinal(spark, bigger))
    assert n == spark.read.parquet(f"{bigger}/documents.parquet").count()
    pairs = [(found[r["doc_id"]]["tail"], r["quality"], found[r["doc_id"]]["kept"]) for r in spark.read.parquet(f"{bigger}/labels.parquet").collect() if r["quality"] is not None and r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    good, bad = [t for t, y, _ in pairs if y == 1], [t for t, y, _ in pairs if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    kept = np.mean([k for _, y, k in pairs if y == 1])
    print("auc", auc, "good kept", kept, "bad kept", np.mean([k for _, y, k in pairs if y == 0]), len(good), len(bad))
    assert auc >= 0.9
    assert kept >= 0.95
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in found.values())


def holds_all_texts(found, texts):
    """Whether the pieces read back are the texts' bytes, closed by one more token and cut at whole bins."""
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(texts)
    for k, pieces in got.items():
        tokens = (texts[k] or "").encode() + b"\xff"
        cut = [tokens[i : i + 8192] for i in range(0, len(tokens), 8192)]
        pieces.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["n_tokens"], r["piece_sha256"]) for r in pieces] == [(i, len(c), brute.sha(c.rstrip(b"\xff"))) for i, c in enumerate(cut)]
        assert all(r["doc_tokens"] == len(tokens) for r in pieces)


def test_packing_matches_plain_best_fit(spark, small, docs):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = q.op3_packing(spark, small).collect()
    holds_all_texts(found, docs)
    cluster = {k: c for k, (_, c) in brute.near(docs, 5, 80).items()}
    assert len(set(cluster.values())) < len(cluster)
    for block in {r["block"] for r in found}:
        mine = sorted((r for r in found if r["block"] == block), key=lambda r: (-r["n_tokens"], r["doc_id"], r["piece"]))
        bins = brute.best_fit([(r["n_tokens"], source[r["doc_id"]], cluster[r["doc_id"]]) for r in mine], 8192, 4)
        assert bins == [r["bin"] for r in mine]
        used, held = {}, {}
        for r in mine:
            used[r["bin"]] = used.get(r["bin"], 0) + r["n_tokens"]
            held.setdefault(r["bin"], []).append(cluster[r["doc_id"]])
        assert max(used.values()) <= 8192
        assert all(r["bin_used"] == used[r["bin"]] for r in mine)
        assert all(len(set(c)) == len(c) for c in held.values())


def test_pipeline_matches_brute_force(spark, small):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{small}/documents.parquet")
    docs, stages = table, dict(p.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "minhash", "suffix_array", "packing"]
    rules = {r["doc_id"]: r["kept"] for r in q.op10_quality_rules(spark, small).collect()}
    docs = stages["quality_rules"](spark, table, small)
    assert docs.columns == table.columns
    assert {r["doc_id"] for r in docs.collect()} == {k for k, kept in rules.items() if kept}
    graded = stages["quality_classifier"](spark, docs, small)
    assert graded.columns == table.columns
    held = {r["doc_id"]: r["text"] for r in graded.collect()}
    assert set(held) <= {r["doc_id"] for r in docs.collect()}
    alone = stages["minhash"](spark, graded, small)
    want = brute.near(held, 5, 80)
    assert {r["doc_id"] for r in alone.collect()} == {k for k, (_, c) in want.items() if k == c}
    held = {k: t for k, t in held.items() if want[k][1] == k}
    cut = stages["suffix_array"](spark, alone, small)
    assert cut.columns == table.columns
    want = brute.repeats(held)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {k: (v[4], len(v[4])) for k, v in want.items() if v[4] or not v[1]}
    packed = stages["packing"](spark, cut, small)
    holds_all_texts(packed.collect(), {r["doc_id"]: r["text"] for r in cut.collect()})


def test_equal_texts_give_equal_media(spark):
    from attesta.llm.media import media_columns

    a, b = media_columns(spark.createDataFrame([(1, "same"), (2, "same")], "doc_id long, text string")).drop("doc_id").collect()
    assert a == b
    assert a["n_bytes"] == 4 and a["payload_bytes"] == 192 and hashlib.sha256(b"same".ljust(192)).hexdigest() == a["payload_sha256"]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_match_their_sql(spark, small, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = db.execute(q.oracle_sql()[name])
    found = q.queries()[name](spark, small)
    names = sorted(found.columns)
    assert names == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
