"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed
greedily into the longest phrases that occur in a language's text; the number of
phrases, times log2 of the reference's length, over the number of symbols estimates
the cross entropy in bits a symbol. The language with the lowest wins (of
equal ones, the first name).

Symbols are bytes of UTF-8 folded to 64 classes: letters A-Z and a-z alike, bytes
from 0x80 in 37 classes, all else one. The automata are dense tables,
in which a missing transition restarts at the root and counts a phrase. All segments of ``SEGMENT``
symbols of a slice of texts are parsed in step, each from the root; then each is parsed again from the
state in which the one before ended, until both parses are in one state, from which on they are the same. A text
with a segment where they never meet (long runs of few symbols) is parsed symbol by symbol. So the phrases
are those of one parse of the whole text, wherever segments end.

The reference is a bounded sample of labelled rows: for each language ``slices``
pieces of ``slice_chars`` characters, of rows chosen by a hash of their id, cut at a
place chosen by another. With many languages each has fewer pieces, so that all have ``most_pieces`` together (and one
each at least): a worker's tables take some 260 KB a piece. Only the sample goes to the driver and the workers. Predictions
read whole texts and nothing else.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is any
text if nothing is labelled. Rows without id are never learned from and count as
held out. Repeated rows are judged alike. An empty table gives an empty result.
The score is 1 - best / second best cross entropy, 1 if only one language is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._workers import only, steps, trimmed

UNKNOWN = "und"
SYMBOLS, SEGMENT = 64, 256

_FOLD = np.zeros(256, np.int32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:] = 27 + np.arange(128) % 37
_LETTER = (_FOLD > 0) & (_FOLD < 27)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if depth[to] == depth[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                depth.append(depth[at] + 1)
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


class Reference:
    """A language's automaton as a dense table, and what a phrase costs in bits."""

    def __init__(self, pieces: tuple[str, ...]):
        symbols: list[int] = []
        for piece in pieces:
            symbols += [*_FOLD[np.frombuffer(piece.encode(), np.uint8)].tolist(), 0]
        moves = suffix_automaton(symbols)
        literal = len(moves)  # after a symbol that the reference lacks
        table = np.empty((literal + 1, SYMBOLS), np.int32)
        table[:] = [moves[0].get(c, literal) * SYMBOLS * 2 + 1 for c in range(SYMBOLS)]
        for state, own in enumerate(moves):
            for c, to in own.items():
                table[state, c] = to * SYMBOLS * 2
        table[0, [c for c in range(SYMBOLS) if c not in moves[0]]] = literal * SYMBOLS * 2
        self.table = table.ravel()
        self.bits = math.log2(len(symbols) + 2)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each segment, and the segments for which this isn't known.

        Segments in order of falling size, none empty; ``before``: the segment that each continues, -1 for a text's first.
        """
        found = (before < 0).astype(np.int64)
        state = np.zeros(len(starts), np.int32)
        trace = np.zeros(len(symbols), np.int32)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for j, n in enumerate(live.tolist()):
            at = starts[:n] + j
            to = self.table.take(state[:n] + symbols[at])
            trace[at] = to
            found[:n] += to & 1
            state[:n] = to >> 1
        who = np.flatnonzero(before >= 0)
        other = state[before[who]]
        apart: list[np.ndarray] = []
        j = 0
        while len(who):
            over = sizes[who] <= j
            apart.append(who[over])
            who, other = who[~over], other[~over]
            to, first = self.table.take(other + symbols[starts[who] + j]), trace[starts[who] + j]
            found[who] += (to & 1) - (first & 1)
            other = to >> 1
            met = other == first >> 1
            who, other, j = who[~met], other[~met], j + 1
        return found, np.concatenate([np.zeros(0, np.int64), *apart])

    def plain(self, symbols: np.ndarray) -> int:
        """Phrases of one text, symbol by symbol."""
        found, state, table = 1, 0, memoryview(self.table)
        for c in symbols.tolist():
            to = table[state + c]
            found += to & 1
            state = to >> 1
        return found


@dataclass(frozen=True)
class Model:
    """The bounded sample: ``((language, pieces), ...)`` in order of names."""

    samples: tuple[tuple[str, tuple[str, ...]], ...]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, references = _compiled(self)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        length = np.diff(offsets)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
        spoken = np.diff(letters) > 0
        for k in np.flatnonzero(~spoken & (length > 0)).tolist():
            spoken[k] = any(c.isalpha() for c in texts[k].as_py())
        judged = np.flatnonzero(spoken) if names else np.zeros(0, np.int64)
        said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(judged):
            return said, score
        parts = -(-length[judged] // SEGMENT)
        owner = np.repeat(np.arange(len(judged)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offsets[judged][owner] + k * SEGMENT
        sizes = np.minimum(SEGMENT, offsets[judged + 1][owner] - starts)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(k > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        symbols = _FOLD[data]
        costs = np.empty((len(references), len(judged)))
        for language, r in enumerate(references):
            found, apart = r.phrases(symbols, starts[order], sizes[order], before)
            costs[language] = np.bincount(owner[order], weights=found, minlength=len(judged)) * r.bits
            for text in np.unique(owner[order][apart]).tolist():
                costs[language, text] = r.plain(symbols[offsets[judged[text]] : offsets[judged[text] + 1]]) * r.bits
        ranked = np.sort(costs, axis=0)
        score[judged] = 1 - ranked[0] / ranked[1] if len(names) > 1 else 1.0
        for at, best in zip(judged.tolist(), costs.argmin(0).tolist(), strict=True):
            said[at] = names[best]
        return said, score


def _compiled(model: Model) -> tuple[list[str], list[Reference]]:
    return only(model, lambda: ([name for name, _ in model.samples], [Reference(pieces) for _, pieces in model.samples]))


def held_out(id_col: Column) -> Column:
    """Whether a row's label is never learned from: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", slices: int = 64, slice_chars: int = 512, most_pieces: int = 1024) -> Model:
    """Learn from labelled rows that aren't held out; at most slices * slice_chars characters a language."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & ~held_out(F.col("id")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return Model(())
    slices = max(1, min(slices, most_pieces // len(counts)))
    #: Some eight times as many rows as are needed, by hash; then the first of them.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 8 * slices / n)) for k, n in counts.items()], "label string, share double")
    dice = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 30))
    some = rows.withColumn("dice", dice).join(F.broadcast(shares), "label").filter(F.col("dice") < F.col("share") * (1 << 30)).filter(F.col("text").rlike("\\p{L}"))
    room = F.greatest(F.length("text") - slice_chars + 1, F.lit(1))
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(32), "id"), room) + 1).cast("int"), F.lit(slice_chars)).alias("piece")
    ranked = some.select("label", "dice", "id", piece).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("dice", "id", "piece"))).filter(F.col("rank") <= slices)
    samples: dict[str, list[str]] = {}
    for r in ranked.orderBy("label", "rank").collect():  # bounded by slices and languages
        samples.setdefault(r["label"], []).append(r["piece"])
    return Model(tuple((k, tuple(v)) for k, v in sorted(samples.items())))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, 2):
            said, score = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    number = docs[id_col].cast("long")
    rows = docs.select(number.alias("doc_id"), held_out(number).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a known language. No shuffle."""
    names = docs.columns
    schema = docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = batch.column(at)
            said, _ = model.predict(texts.fill_null("") if texts.null_count else texts)
            yield batch.filter(pa.array([s != UNKNOWN for s in said]))

    return docs.mapInArrow(trimmed(run), schema)
