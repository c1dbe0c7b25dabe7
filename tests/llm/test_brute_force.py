"""Queries without SQL against plain Python on a small table, and round trips."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from starloom.llm import _components, _workers, bm25, language_id, minhash, packing, queries, substring_dedup, tokenizing
from starloom.llm._words import LONG_WORD, Hasher, split_words
from starloom.llm.language_id import suffix_automaton
from starloom.llm.piece_codec import CharacterMap, Normalizer, PieceCodec, _fields
from starloom.llm.token_codes import Image, encode_image, load, save
from starloom.llm.tokenizing import MemoEncoder

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def without_repeats(texts, window):
    words = {k: WORD.findall(t) for k, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def near_components(texts, width, percent=80):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_substring_dedup(spark, texts):
    want = {k: (n, lost, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, lost, kept) in without_repeats(texts, 35).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substring_dedup(spark, SMALL).collect()} == want
    assert any(lost for _, lost, _ in want.values())


def test_near_duplicates(spark, texts):
    want = near_components(texts, 2)
    got = queries.op9_minhash(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(r.kept for r in got) < len(got)


def alike(n, other=False):
    """Letters a and b in the order of Thue and Morse, for which polynomial hashes modulo 2^64 collide with the complement's."""
    return "".join("ab"[(bin(i).count("1") + other) % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    x, y = alike(2048), alike(2048, True)
    head = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    pair = spark.createDataFrame([(1, f"x {x}"), (2, f"x {y}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(pair, 2).collect()) == [(1, 1), (2, 2)]
    docs = spark.createDataFrame([(1, x), (2, y), (3, "z")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, x)], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in bm25.search(docs, asked).collect()] == [(9, 1)]


def test_links_are_confirmed_on_words(monkeypatch, spark):
    """With hashes that are all alike, links and sets still come from words."""
    texts = ["a b c d", "A b c d", "e f g h i", "a b c d x", "a", "a b"]
    sets = minhash.exact_sets(pa.array(texts), 3)
    by = [set(sets[1][sets[0] == k].tolist()) for k in range(len(texts))]
    assert by[0] == by[1] and not by[0] & by[2] and len(by[0] & by[3]) == 2 and len(by[4]) == len(by[5]) == 1 and by[4] != by[5]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n"), max_size=30), min_size=1, max_size=6), st.integers(1, 6))
def test_sets_are_those_of_plain_python(parts, width):
    want = []
    for p in parts:
        w = WORD.findall(p)
        want.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    for sets in (minhash.shingle_sets, minhash.exact_sets):
        owner, shingles = sets(pa.array(parts), width)
        found = [set(shingles[owner == k].tolist()) for k in range(len(parts))]
        assert [len(f) for f in found] == [len(w) for w in want]
        assert all((len(f & g), len(f | g)) == (len(v & w), len(v | w)) for f, v in zip(found, want) for g, w in zip(found, want))


def test_components_are_those_of_a_search(spark, monkeypatch):
    monkeypatch.setattr(_components, "CHUNK", 7)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (240, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for k in sorted(near):
        if k not in want:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = k
                    todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.component for r in _components.components(df).collect()} == want
    assert _components.components(df.limit(0)).count() == 0


def test_workers_hold_one_object():
    a = _workers.only("a", list)
    assert _workers.only("a", list) is a
    _workers.only("b", list)
    assert _workers.only("a", list) is not a


def test_near_duplicate_chains(spark):
    """A group in which many members are linked only through others, as leaders alone would not find."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    docs = {}
    for k in range(260):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 22), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        docs[k] = " ".join(w)
    want = near_components(docs, 2)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2).collect()} == want
    assert len({c for _, c in want.values()}) > 3


def test_large_groups_are_compared_a_few_members_at_a_time(spark):
    """Two components of one bucket, all with the same signature: a worker holds few of their pairs at once, and tells all of them."""
    half = 600
    signature = np.arange(minhash._COORDINATES, dtype=np.uint16)
    key = int(minhash.band_keys(signature[None])[0, 0].view(np.int64))
    signed = spark.createDataFrame([(k, bytearray(signature.tobytes())) for k in range(2 * half)], "id long, sig binary")
    rows = spark.createDataFrame([(key, k, k // half, k < half, 0, 0) for k in range(2 * half)], "key long, id long, component long, few boolean, near long, far long")

    def report(ids, x, y, alike, once):
        return [np.array([len(x)]), np.array([int(once.sum())])]

    held = minhash._compared(rows, signed, 80, 0.9, report, "n long, once long").collect()
    assert sum(r["n"] for r in held) == sum(r["once"] for r in held) == half * half
    assert max(r["n"] for r in held) <= minhash._PAIRS


def test_packing_and_token_codes(spark, texts):
    library = Tokenizer.from_file(BPE)
    ids = {k: e.ids for k, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    rows = queries.op6_best_fit_packing(spark, SMALL).collect()
    for r in rows:
        assert crc((ids[r.doc_id] + [0])[r.start : r.start + r.length]) == r.ids_crc32
    total = sum(len(x) + 1 for x in ids.values())
    bins = collections.defaultdict(list)
    for r in rows:
        assert r.length == 2048 or r.piece == 0
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():  # gapless from 0
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1]) and sum(n for _, n in places) <= 2048
    assert sum(r.length for r in rows) == total and len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_codes(spark, SMALL).collect()}
    at = 0
    for k in sorted(ids):
        assert got[k] == (at, len(ids[k]) + 1, crc(ids[k] + [2]))
        at += len(ids[k]) + 1


def test_piece_codec(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op10_piece_codec(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_language_id_is_right_on_held_out_rows(spark):
    said = queries.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = said.join(truth, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_pipeline(spark, texts):
    """All stages against plain Python: no text of this table lacks a language."""
    rows = corpus_pipeline.run(spark, SMALL).collect()
    best = {}
    for k in sorted(texts):
        best[texts[k]] = k
    left = {k: texts[k] for k in best.values()}
    root = near_components(left, 5)
    left = {k: t for k, t in left.items() if root[k][1] == k}
    cut = without_repeats(left, 35)
    left = {k: cut[k][2] if cut[k][1] else t for k, t in left.items()}
    library = Tokenizer.from_file(BPE)
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in left.items()}
    got, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == {k: len(x) for k, x in ids.items()}
    for filled in places.values():
        filled.sort()
        assert [o for o, _ in filled] == list(np.cumsum([0, *(n for _, n in filled)])[:-1]) and sum(n for _, n in filled) <= 2048


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab Zé,.'\n\t\r  　\x1c\x85日😀_09<|>×÷sdtlmrev"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4), st.sampled_from([3, 10**6]))
def test_memo_encoder_is_the_library(parts, entries):
    memo, before = _memo(), tokenizing.MEMO_ENTRIES
    parts = [*parts, "x <|endoftext|>" + parts[0], "word " * 30]
    tokenizing.MEMO_ENTRIES = entries
    try:
        ids, edges = memo.encode(pa.array(parts))
    finally:
        tokenizing.MEMO_ENTRIES = before
    assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] == memo.whole(parts)


_kept = {}


def _memo():
    return _kept.setdefault("memo", MemoEncoder(BPE))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50), max_size=8), st.sampled_from([8, 16]))
def test_token_codes_round_trip(docs, bits):
    image = Image(encode_image(list(range(len(docs))), [np.array(d, np.uint32) for d in docs], bits))
    assert [d.tolist() for _, _, d in image.documents()] == docs
    flat = [x for d in docs for x in d]
    assert [image[k] for k in range(len(flat))] == flat
    assert all(image.tokens(a, b).tolist() == flat[a:b] for a in range(0, len(flat), 7) for b in range(a, len(flat) + 1, 5))


def test_token_codes_random_access_over_many_blocks(tmp_path):
    ids = np.random.default_rng(1).integers(0, 70_000, 5_000).astype(np.uint32)
    save(str(tmp_path / "x.sltc"), encode_image([None], [ids]))
    image = load(str(tmp_path / "x.sltc"))
    assert image.doc_ids == [None] and [image[k] for k in range(0, 5_000, 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        image[5_000]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plans_use_up_all_pieces(counts):
    used = collections.Counter()
    for times, lengths in packing.plan(counts, 64):
        assert times > 0 and sum(x * n for x, n in lengths) <= 64
        for x, n in lengths:
            used[x] += times * n
    assert used == collections.Counter(counts)


def test_exact_complements_are_found():
    assert sum(t for t, _ in packing.plan({40: 5, 24: 5, 30: 3, 20: 3, 14: 3, 33: 2, 11: 2, 10: 4}, 64)) == 5 + 3 + 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("a b\n日"), max_size=30), min_size=1, max_size=5))
def test_words_and_hashes(parts):
    words = split_words(pa.array(parts))
    found = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert found == [w for p in parts for w in WORD.findall(p)]
    hashes = words.hashes(Hasher(1))
    assert len(set(hashes.tolist())) == len(set(found))


def test_long_words_hash_alike_anywhere():
    big = "x" * (LONG_WORD + 5)
    h = split_words(pa.array([f"a {big} b", f"{big}", f"b a {big}"])).hashes(Hasher(1))
    assert h[1] == h[3] == h[6] and h[0] == h[5] and h[2] == h[4]


def test_suffix_automaton_knows_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    moves = suffix_automaton(text)

    def has(part):
        at = 0
        for c in part:
            if c not in moves[at]:
                return False
            at = moves[at][c]
        return True

    subs = {tuple(text[a:b]) for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
    assert all(map(has, subs)) and not has((3, 3)) and not has((2, 2))


def test_character_maps_are_those_of_the_library():
    rng = np.random.default_rng(2)
    letters = list(" \n\t　 aäßabcé日本😀̀​▁,.'0ﬁ①ＡＢカﾞ가㍿")
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        parts = {n: v for number, _, _, value in _fields(library.serialized_model_proto()) if number == 3 for n, _, _, v in _fields(value)}
        mine = Normalizer(parts[2])
        assert isinstance(mine.map, CharacterMap)
        for _ in range(300):
            text = "".join(rng.choice(letters, rng.integers(0, 20)))
            out, source = mine(text.encode())
            assert out.decode() == library.normalize(text) and len(source) == len(out) + 1 and (np.diff(source) >= 0).all()


def test_spans_cover_the_original():
    codec, library = PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in (" a  b", "Hello wörld\n日本 😀", "▁x ", "\x00"):
        ids, spans = codec.encode_spans(text)
        assert ids == library.encode(text) and spans[0, 0] == 0 and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] <= spans[:-1, 1]).all()


def plain_parse(reference, text):
    """Phrases of the greedy parse of ``text`` into the longest substrings of ``reference``."""
    found = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(reference[i : i + size + 1] == text[at : at + size + 1] for i in range(len(reference))):
            size += 1
        found, at = found + 1, at + size
    return found


def test_cross_parse_is_that_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["der", "die", "und", "maison", "the", "of", "écl", "zzz", "q"]
    pieces = tuple(" ".join(rng.choice(words[:7], 12)) for _ in range(3))
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 40, 200)] + ["e" * 700, "der" * 200, "日本 " * 50, "x"]
    reference = language_id.Reference(pieces)
    folded = lambda t: language_id._FOLD[np.frombuffer(t.encode(), np.uint8)].tolist()
    whole = [c for p in pieces for c in [*folded(p), 0]]
    model = language_id.Model((("a", pieces), ("b", ("the of the of",))))
    other = language_id.Reference(("the of the of",))
    other_whole = [*folded("the of the of"), 0]
    want = [(plain_parse(whole, folded(t)) * reference.bits, plain_parse(other_whole, folded(t)) * other.bits) for t in texts]
    for segment in (7, 256):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        said, score = model.predict(pa.array(texts))
        assert [s != "und" for s in said] == [True] * len(texts)
        assert np.allclose(score, [1 - min(w) / max(w) for w in want])
        assert [s for s in said] == ["a" if w[0] <= w[1] else "b" for w in want]


def test_search_skips_blocks_and_is_exact(spark, monkeypatch):
    """Posting blocks and ranges of documents are left out, and the best k are those of all scores."""
    monkeypatch.setattr(bm25, "BLOCK", 4)
    rng = np.random.default_rng(6)
    vocabulary = [f"t{k}" for k in range(60)]
    docs = [" ".join(rng.choice(vocabulary[10 * (k % 6) : 10 * (k % 6) + 14], rng.integers(3, 40))) for k in range(240)]
    bag = [collections.Counter(d.split()) for d in docs]
    held = collections.Counter(t for b in bag for t in b)
    mean = sum(sum(b.values()) for b in bag) / len(bag)
    names = np.array([int(x) for x in split_words(pa.array(vocabulary)).hashes(bm25._WORD)], np.uint64)
    number = dict(zip(vocabulary, names, strict=True))
    rows = sorted((k, int(number[t]), n) for k, b in enumerate(bag) for t, n in b.items())
    owner, terms, counts = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.uint64, np.uint32), strict=True))
    common = sorted(sorted(held, key=lambda t: -held[t])[:5], key=lambda t: int(number[t]))
    shard = bm25.Shard(np.arange(240), np.ones(240, bool), np.array([sum(b.values()) for b in bag]), owner, terms, counts, np.array([number[t] for t in common], np.uint64), mean)
    idf = {t: np.log1p((240 - n + 0.5) / (n + 0.5)) for t, n in held.items()}

    def asked(b):
        some, rest = [t for t in b if t in common], sorted((t for t in b if t not in common), key=lambda t: int(number[t]))
        return np.array([common.index(t) for t in some], np.int64), np.array([idf[t] for t in some]), np.array([number[t] for t in rest], np.uint64), np.array([idf[t] for t in rest])

    for q, places, scores in shard.top([asked(b) for b in bag[:50]], 3):
        want = np.zeros(240)
        for k, b in enumerate(bag):
            dl = sum(b.values())
            want[k] = sum(idf[t] * b[t] * (bm25.K1 + 1) / (b[t] + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean)) for t in bag[q] if t in b)
        best = sorted(zip(np.round(-scores, 9), shard.ids[places]))[:3]
        assert [i for _, i in best] == [i for _, i in sorted((round(-w, 9), i) for i, w in enumerate(want))[:3]]
    assert 0 < shard.read < shard.seen and 0 < shard.ranges_read < shard.ranges_seen


def test_search_stores_queries_and_shards_once(spark, texts, monkeypatch):
    """No copy of a query for each shard, nor of a shard for each query: few rows are stored, however many shards meet however many queries."""
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 20)
    stored, hits = [], []
    keep, write = bm25._stored, bm25.checkpointed
    monkeypatch.setattr(bm25, "_stored", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(bm25, "checkpointed", lambda df: hits.append(write(df)) or hits[-1])
    rows = sorted(texts.items())[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = docs.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in bm25.search(docs, asked, k=3, shard_docs=10).collect()}
    n = sum(k % 4 == 0 for k, _ in rows)
    shards, blocks = (df.count() for df in stored)
    assert 20 <= shards <= 24 and blocks == -(-n // 20) and hits[-1].count() <= 3 * n * bm25.MOST_GROUPS
    bag = {k: collections.Counter(WORD.findall(t.translate(LOWER))) for k, t in rows}
    held = collections.Counter(t for b in bag.values() for t in b)
    mean = sum(sum(b.values()) for b in bag.values()) / len(bag)

    def score(q, b):
        dl = sum(b.values())
        return sum(np.log1p((len(bag) - held[t] + 0.5) / (held[t] + 0.5)) * b[t] * (bm25.K1 + 1) / (b[t] + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean)) for t in q if t in b)

    for k, q in bag.items():
        if k % 4 == 0:
            best = sorted((-round(s, 6), i) for i, b in bag.items() if (s := score(q, b)) > 0)[:3]
            assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in best] == [got[k, r] for r in range(1, len(best) + 1)]


def test_shards_are_read_back_and_keep_to_floors():
    rng = np.random.default_rng(2)
    owner, terms = (a.ravel() for a in np.meshgrid(np.arange(300), np.arange(1, 41, dtype=np.uint64), indexing="ij"))
    counts = rng.integers(0, 4, len(owner)).astype(np.uint32)
    there = counts > 0
    shard = bm25.Shard(np.arange(300) - 9, np.arange(300) != 5, np.full(300, 60), owner[there], terms[there], counts[there], np.arange(1, 6, dtype=np.uint64), 60.0)
    again = bm25.Shard.load(pa.py_buffer(shard.dump()), 5, 60.0)
    asked = [(np.arange(3), np.ones(3), np.arange(6 + q, 30, dtype=np.uint64), np.arange(6 + q, 30) / 10) for q in range(5)]
    whole, read = ({q: dict(zip(s.ids[d].tolist(), x, strict=True)) for q, d, x in s.top(asked, 4)} for s in (shard, again))
    assert whole == read and len(whole) == 5
    floors = np.array([max(x.values()) for x in whole.values()])
    for q, docs, x in again.top(asked, 4, floors):
        assert x.max() == floors[q] and len(docs) < len(whole[q])
    assert not list(again.top(asked, 4, floors + 1))


def test_alike_documents_share_ranges():
    """Two subjects, which the direction in which documents differ most doesn't set apart: documents of a range are of one subject."""
    rng = np.random.default_rng(4)
    subject = rng.permutation(np.repeat(np.arange(2), 16 * bm25.BLOCK))
    rows = np.stack([rng.random(len(subject)), 0.4 * subject], axis=1).astype(np.float32)
    order = bm25._alike(rows)
    assert sorted(order.tolist()) == list(range(len(rows)))
    subjects = [len(set(part)) for part in subject[order].reshape(-1, bm25.BLOCK).tolist()]
    assert sum(subjects) < 1.5 * len(subjects)


def test_lists_read_whole_give_the_same_hits(monkeypatch):
    """However many blocks are read, hits are the same, and no query's list counts as read more than once."""
    rng = np.random.default_rng(3)
    owner, terms = (a.ravel() for a in np.meshgrid(np.arange(700), np.arange(1, 41, dtype=np.uint64), indexing="ij"))
    counts = rng.integers(0, 3, len(owner)).astype(np.uint32)
    there = counts > 0
    asked = [(np.arange(3), np.ones(3), np.arange(6 + q, 30, dtype=np.uint64), np.arange(6 + q, 30) / 10) for q in range(70)]
    asked = [(c, w, t % 30 + 6, (t % 30 + 6) / 10) for c, w, t, _ in asked]
    found = []
    for share in (0.0, 0.5, 1.0):
        monkeypatch.setattr(bm25, "MOST_READ", share)
        shard = bm25.Shard(np.arange(700), np.ones(700, bool), np.full(700, 60), owner[there], terms[there], counts[there], np.arange(1, 6, dtype=np.uint64), 60.0)
        found.append({q: sorted(zip(shard.ids[d].tolist(), np.round(x, 9).tolist(), strict=True)) for q, d, x in shard.top(asked, 4)})
        assert 0 < shard.read <= shard.seen
    assert found[0] == found[1] == found[2] and all(len(found[0][q]) >= 4 for q in range(24))


def test_shards_are_small_and_go_to_workers_one_by_one(spark):
    """Two workers of an executor hold a shard and its row each, whatever the size of batches."""
    assert bm25.SHARD_DOCS <= 4096 and bm25.SHARD_WORDS <= 3_000_000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with bm25._one_at_a_time(spark):
        sizes = spark.range(0, 5, 1, 1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert [r.n for r in sizes] == [1] * 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
