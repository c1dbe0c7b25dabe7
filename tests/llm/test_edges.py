"""Null, empty, very long, repeated and clashing input for each operator and stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import bm25, chat_format, exact_dedup, language_id, minhash, packing, piece_codec, queries, substring_dedup, token_codes, url_filter
from tests.llm.conftest import LONG, ODD

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_url_filter(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no-scheme/casino", "x"), (4, "HTTP://Spam.Example.ORG/es/1?x", "x"), (4, "HTTP://Spam.Example.ORG/es/1?x", "x"), (None, "ftp://a.fr/free/bets", "x"), (6, "http://x.org" + "/free" * 50_000, "x"), (7, "http://freebets.net/bonus1", "x"), (8, "http://h?x=http://y/z", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    policy = url_filter.UrlPolicy(rules=queries.URL_RULES)
    got = sorted(((r.page_id or 0, r.host, r.path[:6], r.rule, r.verdict) for r in url_filter.judge_urls(pages, policy).collect()), key=str)
    assert got == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "block"), *[(4, "spam.example.org", "/es/1", "example.org/es/", "block")] * 2, (0, "a.fr", "/free/", None, "block"), (6, "x.org", "/free/", "org/", "allow"), (7, "freebets.net", "/bonus", None, "allow"), (8, "h", "", None, "allow")], key=str
    )
    assert url_filter.judge_urls(pages.limit(0), policy).count() == 0
    judge = url_filter.UrlJudge(url_filter.UrlPolicy()).judge
    verdicts = {"http://a.b/poker/poker/poker": "allow", "http://a.b/free/win": "allow", "http://a.b/free/win/click": "block", "http://a.b/free-poker": "block", "http://a.b/xxx": "block", "http://a.b/axxx": "allow"}
    assert {u: judge(u)[3] for u in verdicts} == verdicts
    heavy = url_filter.UrlJudge(url_filter.UrlPolicy(soft={"big": 9, "small": 1})).judge
    assert heavy("http://a.b/big")[3] == "allow" and heavy("http://a.b/big/small")[3] == "block"


def test_chat_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, None, None), (4, 0, "user", "hi"), (4, 1, "bot", "yo"), (4, 2, None, ""), (5, 0, "user", LONG), (6, 0, "user", LONG), (None, 0, "user", "hi"), (None, 1, "x", "y"), (7, None, "user", "hi"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, n long")
    got = {r.conv_id: r for r in chat_format.collapse_and_render(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: "snapshot", 2: "snapshot", 3: "maximal", 4: "maximal", 5: "maximal", 6: "repeat", None: "maximal", 7: "snapshot", 8: "maximal"}
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>\n<|im_end|>\n" and got[1].rendered is None
    assert chat_format.collapse_and_render(df.limit(0)).count() == 0


def test_chat_format_hashes_anew_where_turns_clash(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "b"), (2, 1, "u", "c")], "conv_id long, turn long, role string, text string")
    real, salts = chat_format.prefix_hashes, []

    def weak(turns, salt=0):
        salts.append(salt)
        hashed = real(turns, salt)
        return hashed.withColumns({"ha": F.lit(1), "hb": F.lit(1)}) if not salt else hashed

    monkeypatch.setattr(chat_format, "prefix_hashes", weak)
    assert {r.conv_id: r.reason for r in chat_format.maximal_conversations(df).collect()} == {1: "maximal", 2: "maximal"} and salts == [0, 1]


def test_exact_dedup(odd, empty):
    got = {(r.id, r.text_sha256): r for r in exact_dedup.label_copies(odd).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[2].kept) == (2, 2, True)
    assert (by_id[4].keep_id, by_id[4].kept, by_id[5].group_size, by_id[5].kept) == (5, False, 3, True)
    assert by_id[6].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.label_copies(empty).count() == exact_dedup.keep_one(empty).count() == 0


def test_exact_dedup_looks_at_bytes_where_hashes_collide(odd):
    bad = lambda text: F.lit(b"same")
    good = {(r.id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.label_copies(odd).collect()}
    assert good == {(r.id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.label_copies(odd, digest=bad).collect()}
    assert exact_dedup.keep_one(odd, digest=bad).count() == 8
    smallest = {r.id: r.keep_id for r in exact_dedup.label_copies(odd, keep="min").collect()}
    assert smallest[5] == 4 and smallest[2] == 1


def test_substring_dedup(odd, empty):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert (got[6].n_words, got[6].n_removed, got[7].kept_text) == (30_000, 30_000, "end")
    assert (got[1].n_words, got[1].kept_text, got[9].n_words, got[4].n_removed) == (0, "", 1, 0)
    rows = substring_dedup.without_repeats(odd)
    assert rows.columns == odd.columns and rows.count() == len(ODD)
    kept = {r.doc_id: r for r in rows.collect()}
    assert (kept[7].text, kept[7].n_chars, kept[3].text, kept[1].text) == ("end", 3, " \n\t ", None)
    assert substring_dedup.remove_repeats(empty).count() == substring_dedup.without_repeats(empty).count() == 0


def test_search(odd, empty):
    asked = odd.filter("doc_id in (4, 6, 1)").select(F.col("doc_id").alias("query_id"), "text")
    got = [(r.query_id, r["rank"], r.doc_id) for r in bm25.search(odd, asked, k=3, shard_docs=4).collect()]
    assert sorted(x for x in got if x[0] == 4) == [(4, 1, 4), (4, 2, 5), (4, 3, 5)]
    assert [x[2] for x in sorted(got) if x[0] == 6] == [6, 7] and not [x for x in got if x[0] == 1]
    assert bm25.search(empty, asked).count() == 0 and bm25.search(odd, asked.limit(0)).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd, BPE).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    total = sum(r.length for r in rows)
    assert len(used) - -(-total // 2048) <= 1 and packing.pack(empty, BPE).count() == 0


def test_language_id(odd, empty, spark):
    texts = [(k, t, l) for k in range(60) for t, l in ((f"the house and the garden number {k} with green trees", "en"), (f"das haus und der garten nummer {k} mit bäumen", "de"))]
    train = spark.createDataFrame([(2 * k + i, t, l) for i in (0, 1) for k, (_, t, l) in enumerate(texts[i::2])], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert {k: r.lang_pred for k, r in got.items() if r.lang_pred == "und"} == {1: "und", 2: "und", 3: "und"}
    assert got[None].held_out and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 6, 7, 8, 9]
    nothing = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"} and language_id.predict(empty, model).count() == 0


def test_token_codes(spark, odd, empty, tmp_path):
    token_codes.write(odd, str(tmp_path / "a"), BPE, 2, shard_tokens=1000)
    rows = sorted(((r.start, r.n_tokens, r.doc_id) for r in token_codes.read(spark, str(tmp_path / "a")).collect()))
    assert rows[0][2] is None and [r[2] for r in rows[1:]] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[1][1] == 1
    token_codes.write(empty, str(tmp_path / "b"), BPE, 2)
    assert token_codes.read(spark, str(tmp_path / "b")).count() == 0


def test_minhash(odd, empty):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd, width=2).collect()}
    assert (got[1].n_shingles, got[1].component_id, got[2].component_id) == (0, 1, 2)
    assert (got[5].component_id, got[5].kept, got[4].kept, got[7].component_id, got[None].component_id) == (4, False, True, 6, None)
    assert minhash.near_duplicates(empty).count() == 0


def test_piece_codec(odd, empty):
    got = {r.doc_id: r for r in piece_codec.round_trip(odd, PIECES).collect()}
    assert (got[1].n_tokens, got[1].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    texts = dict(ODD)
    assert all(got[k].decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() and got[k].spanned_bytes == len(texts[k].encode()) for k in (4, 6, 7, 8, 9))
    assert piece_codec.round_trip(empty, PIECES).count() == 0
    spans = {r.doc_id: r for r in piece_codec.encode_documents(odd.filter("doc_id = 8"), PIECES).collect()}[8]
    assert spans.begins[0] == 0 and spans.ends[-1] == len(texts[8].encode())


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_stages(spark, which, request, tmp_path):
    docs = request.getfixturevalue(which)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{which}{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{which}{k}"))
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    if which == "odd":
        assert {r.doc_id for r in docs.collect()} == {None, 5, 6, 8, 9}
