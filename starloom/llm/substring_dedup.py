"""Substring deduplication: words in repeated windows of ``window`` words are removed.

A window is ``window`` consecutive words of one text. Each word that is covered by a
window whose words also start anywhere else, the same text included, is removed.

Difference-cover anchors find the candidates. ``COVER`` is a difference cover modulo
``PERIOD``: for any two places some shift below the period brings both to cover
positions. So two equal windows share an equal anchor, ``window - PERIOD + 1`` words
long, at cover positions of both texts, and only anchors at cover positions (5 of
21) are hashed and shuffled. Anchors found twice are extended: the windows that
contain one, and only those, are compared by 128 bits, two independent hashes over all their
words. (The words themselves don't travel: beside the texts, they'd take more room than
the windows' hashes. Equal hashes of different windows are as unlikely as for any 128-bit hash.)

Rows of equal text (by 80 bits of hashes of its SHA-256) are one text with several copies, which
all of its windows repeat; it is compared with others once.

Skew: within a slice of texts a repeated anchor or window is known to repeat at
once, runs of such windows go on as one row, and a single witness of each key is shuffled. So a passage in
a third of all texts sends one row of some 24 bytes for each slice of about 2 MB; those of one key meet in a
window, which spills. Places found to repeat go back to their texts by the content key. A
text's places are bounded by its own length.

Defined cases: a null text has no words; its kept text is empty. Rows that repeat a
text, with the same id or not, are places of their own, so whole texts of ``window``
words or more go from all of them. Null ids are allowed. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from starloom.llm._words import Hasher, Words, mix, split_words
from starloom.llm._workers import lean, steps

#: A perfect difference set: each of 1..20 is the difference of two members modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

_ANCHOR, _WINDOW = Hasher(11), (Hasher(12), Hasher(13))


def _lines(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ranges of so many words within one text, and the text of each."""
    doc = words.doc_of()
    n = len(doc) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return at, doc[at]


def _once(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether its key occurs again; and one row for each key."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    new = np.concatenate([[True], ~same])[: len(order)]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    repeated = np.empty(len(order), bool)
    repeated[order] = np.repeat(sizes > 1, sizes)
    return repeated, order[new]


def _key(docs: DataFrame, text_col: str) -> list[Column]:
    """A text's content key, ``k`` and the 16 bits ``t``, and the text without nulls. None is null, and Spark is to
    know that: filters for nulls on one side of a join would make exchanges of the texts differ."""
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = F.sha2(text, 256)
    return [F.xxhash64(digest).alias("k"), F.coalesce(F.crc32(F.encode(digest, "UTF-8")), F.lit(0)).bitwiseAND(F.lit((1 << _T_BITS) - 1)).alias("t"), text.alias("text")]


#: Of ``flags``, from the lowest bit: known, twice, the place (46 bits), ``t``.
_KNOWN, _TWICE, _T_BITS, _T_SHIFT = 1, 2, 16, 48
#: Bits of an anchor's key that are kept (others only pass more candidates), and of the number that deals out known places.
_ANCHOR_BITS, _DEALT_BITS = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0xFFFFFFFF00000000)
_PLACES = {1: "a long, k long, flags long", 2: "a long, b long, k long, flags long"}
#: Bits of a run of places that hold its first one; the higher ones hold how many there are.
_RUN_SHIFT = 32


def _places(batch: pa.RecordBatch, doc: np.ndarray, place: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    """One witness row for each key, and rows for the places known to repeat already.

    Known places are not compared any more; their first key only deals them out evenly. With two keys, neighbours
    among them make one row, whose second key is their number.
    """
    repeated, witness = _once(keys)
    known = np.flatnonzero(repeated)
    sizes = np.ones(len(known), np.uint64)
    if len(keys) == 2 and len(known):
        first = np.flatnonzero(np.concatenate([[True], (doc[known[1:]] != doc[known[:-1]]) | (place[known[1:]] != place[known[:-1]] + 1)]))
        sizes = np.diff(np.append(first, len(known))).astype(np.uint64)
        known = known[first]
    rows = np.concatenate([witness, known])
    text = pa.array(doc[rows])
    flags = place[rows] * 4 + (batch.column(1).take(text).to_numpy() << _T_SHIFT)
    flags[: len(witness)] += repeated[witness] * _TWICE
    flags[len(witness) :] += _KNOWN
    columns = [k[rows] for k in keys]
    columns[0][len(witness) :] = mix(columns[0][len(witness) :] + place[known].astype(np.uint64) + mix(doc[known].astype(np.uint64))) & _DEALT_BITS
    for c in columns[1:]:
        c[len(witness) :] = sizes
    return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), batch.column(0).take(text), pa.array(flags)], names=["a", "b"][: len(keys)] + ["k", "flags"])


def _repeated(places: DataFrame) -> DataFrame:
    """``k, t, places``: of each text, the runs of places whose key starts elsewhere too.

    Witnesses of one key from several slices make each of them a repeated place; in
    slices that hold the key twice, the places are known.
    """
    keys = [c for c in ("a", "b") if c in places.columns]
    is_known = F.col("flags").bitwiseAND(F.lit(_KNOWN)) > 0
    is_twice = F.col("flags").bitwiseAND(F.lit(_TWICE)) > 0
    n = F.sum(F.when(is_known, 0).otherwise(1)).over(Window.partitionBy(*keys))
    found = places.withColumn("n", n).filter(is_known | ((F.col("n") > 1) & ~is_twice))
    place = F.shiftright("flags", 2).bitwiseAND(F.lit((1 << _T_SHIFT - 2) - 1))
    size = F.when(is_known, F.col("b")).otherwise(1) if len(keys) == 2 else F.lit(1)
    run = place + F.shiftleft(size.cast("long"), _RUN_SHIFT)
    return found.groupBy("k", F.shiftrightunsigned("flags", _T_SHIFT).alias("t")).agg(F.collect_list(run).alias("places"))


def _marked(words: Words, places: pa.Array, before: int, after: int) -> np.ndarray:
    """How many ranges [first - before, last + after] cover each word; a list of runs of places for each text."""
    flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    first, last = flat & ((1 << _RUN_SHIFT) - 1), (flat & ((1 << _RUN_SHIFT) - 1)) + (flat >> _RUN_SHIFT) - 1
    sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(places)), sizes)
    low, high = words.first[text], words.first[text + 1]
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, np.maximum(first + low - before, low), 1)
    np.add.at(change, np.minimum(last + low + after + 1, high), -1)
    return np.cumsum(change)[:-1]


def repeated_windows(docs: DataFrame, window: int = 35, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts ``k, t, text, copies``, and ``k, t, places``: the starts of their windows that other texts or places have."""
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"the window must hold at least {PERIOD} words")
    texts = docs.select(*_key(docs, text_col)).groupBy("k", "t").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, 2):
            words = split_words(batch.column(2))
            at, doc = _lines(words, anchor)
            place = at - words.first[doc]
            chosen = in_cover[place % PERIOD] & (np.diff(words.first)[doc] >= window)
            at, doc, place = at[chosen], doc[chosen], place[chosen]
            if len(at):
                a = _ANCHOR.windows(words.hashes(_ANCHOR), anchor)[at] & _ANCHOR_BITS
                yield _places(batch, doc, place, [a])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, 2):
            words = split_words(batch.column(2))
            at, doc = _lines(words, window)
            holds = _marked(words, batch.column(4), PERIOD - 1, 0) > 0
            at, doc = at[holds[at]], doc[holds[at]]
            if len(at):
                a, b = (h.windows(words.hashes(h), window)[at] for h in _WINDOW)
                yield _places(batch, doc, at - words.first[doc], [a, b])

    # all uses of ``texts`` take all its columns, so that its exchange is written once and reused
    shared = _repeated(texts.mapInArrow(lean(anchors), _PLACES[1]))
    candidates = texts.join(shared, ["k", "t"]).select("k", "t", "text", "copies", "places")
    return texts, _repeated(candidates.mapInArrow(lean(windows), _PLACES[2]))


def _cut(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """``k, t, n_words, n_removed, kept_text`` of the distinct texts."""
    texts, found = repeated_windows(docs, window, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, 2):
            words = split_words(batch.column(2))
            n = np.diff(words.first)
            gone = _lost(batch, words, window)
            lost = np.bincount(words.doc_of()[gone], minlength=len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(lost), join_words(words, ~gone)], names=["k", "t", "n_words", "n_removed", "kept_text"])

    rows = texts.join(found, ["k", "t"], "left").select("k", "t", "text", "copies", "places")
    return rows.mapInArrow(lean(cut), "k long, t long, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: kept words joined by one space, one row for each
    input row. With ``digest``, ``kept_sha256`` takes the kept text's place before rows are joined."""
    kept = F.sha2("kept_text", 256).alias("kept_sha256") if digest else F.col("kept_text")
    results = _cut(docs, window, text_col).select("k", "t", "n_words", "n_removed", kept)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *_key(docs, text_col)[:2])
    return rows.join(results, ["k", "t"]).drop("k", "t")


def without_repeats(docs: DataFrame, window: int = 35, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns; texts that lose words are replaced by
    what they keep (and ``length_col``, if there is one, by its length), others stay as they are.

    Other columns join the distinct texts before those are cut, so texts move once.
    """
    texts, found = repeated_windows(docs, window, text_col)
    others = F.struct(docs[text_col].isNull().alias("_none"), *[docs[c] for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(*_key(docs, text_col)[:2], others)
    joined = texts.join(found, ["k", "t"], "left").join(rows, ["k", "t"]).select("k", "t", "text", "copies", "places", "row")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("changed", BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, 2):
            words = split_words(batch.column(2))
            gone = _lost(batch, words, window)
            changed = pa.array(np.bincount(words.doc_of()[gone], minlength=batch.num_rows) > 0)
            text = pc.if_else(changed, join_words(words, ~gone), batch.column(2).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(5), text, changed], names=["row", "text", "changed"])

    out = joined.mapInArrow(lean(cut), schema)
    text = F.when(~F.col("row._none"), F.col("text"))
    new = {text_col: text}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("changed"), F.length("text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _lost(batch: pa.RecordBatch, words: Words, window: int) -> np.ndarray:
    """The words that go, for rows ``k, t, text, copies, places``."""
    gone = _marked(words, batch.column(4), 0, window - 1) > 0
    copied = (batch.column(3).to_numpy() > 1) & (np.diff(words.first) >= window)
    return gone | copied[words.doc_of()]


def join_words(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    doc = words.doc_of()[kept]
    starts, ends = words.starts[kept], words.ends[kept]
    more = np.zeros(len(doc), np.int64)
    more[:-1] = doc[1:] == doc[:-1]  # another kept word follows, so a byte of white space does too
    data = np.append(words.data, np.uint8(0x20))
    data[ends[more > 0]] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, starts, 1)
    np.add.at(change, ends + more, -1)
    out = data[np.cumsum(change[:-1], dtype=np.int8) > 0]
    sizes = np.bincount(doc, weights=ends - starts + more, minlength=len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(out)]).cast(pa.string())
