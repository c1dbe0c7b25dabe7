"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds its distinct shingles of ``width`` words, with A-Z in lower
case; with fewer words the whole sequence is one shingle. Documents are linked if
100 * |intersection| >= ``percent`` * |union|; a component is what links reach.

1. Signatures need two permutations only: the first places a shingle in a universe
   of 2^20, the second ranks the places, and coordinate k is the least rank after
   a circular shift by k. 51 bands of 5 coordinates miss a pair at 0.8 about twice
   in 10^9. Rows of equal text (BLAKE2b, 128 bits) are one class; its smallest id stands for it.
2. In each bucket of a band, every class is paired with one head: the member that
   shares most buckets with others. So pairs grow with members, not their square.
   Links give first components. Every link is confirmed on full sets, and these are compared by
   their words, not by hashes.
3. Two members of a bucket that are still in different components may be linked
   yet. Each member outside its bucket's largest component meets all others of a quarter of the
   buckets, in blocks of 1024 signatures, and its three most alike partners are verified. That
   joins most of those that belong together.
4. Then, in all buckets, members with a partner in another component whose signature agrees
   within ``SIGMAS`` standard errors of the limit are doubtful. How far each is from its bucket's head
   settles most of them: with Dx the shingles that only one of x and the head has,
   |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, and what no other doubtful member has in its difference can't be
   in Dx & Dy. So a copy with changes of its own is ruled out by two numbers, without meeting anybody. Pairs whose
   numbers leave room are verified. Components are formed anew each time.

Buckets are split and joined, never collected. Rows sent grow with members; blocks compare signatures of
members outside the largest component with those of others in memory, and send on pairs that step 3 or 4 asks for.

Defined cases: null or word-less texts have an empty set and are linked with
nothing. Ids are to be unique: classes whose smallest id is the same (or missing) are
taken for one document when linked. Repeated rows share class, component and
decision. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._components import components
from starloom.llm._words import Hasher, Words, mix, split_words
from starloom.llm._workers import STEP_BYTES, column_bytes, lean, steps
from starloom.session import checkpointed

BANDS, ROWS = 51, 5
UNIVERSE_BITS = 20
BLOCK = 1024
#: Pairs that are compared at a time.
_PAIRS = 8192
#: How many standard errors below the limit a signature's agreement may be; beyond, one in some 10^8 linked pairs is lost.
SIGMAS = 6
#: How many partners a member tries at a time before all that are left are looked at.
BEST = 3

_COORDINATES = BANDS * ROWS
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HASH = Hasher(21)
_NO_ID = -(1 << 63)


class Circulant:
    """The two permutations, and signatures of sets given as sorted (set, shingle) rows."""

    def __init__(self, seed: int = 25):
        rng = np.random.Generator(np.random.PCG64(seed))
        rank = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:_COORDINATES]]), _COORDINATES)
        self.salt = rng.integers(0, 1 << 64, dtype=np.uint64)

    def signatures(self, owner: np.ndarray, shingles: np.ndarray, n: int, step: int = 8192) -> np.ndarray:
        out = np.full((n, _COORDINATES), (1 << 32) - 1, np.uint32)
        place = (mix(shingles ^ self.salt) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        for at in range(0, len(place), step):
            own = owner[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(self.shifted[place[at : at + step]], first, axis=0)
            out[own[first]] = np.minimum(out[own[first]], least)
        return (out & 0xFFFF).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mix(keys ^ (parts[:, :, j] + np.uint64(j << 32)))
    return keys


def _shingled(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the shingles of texts with ``width`` words or more start, and the texts that have fewer (but some)."""
    doc, n = words.doc_of(), np.diff(words.first)
    m = max(len(doc) - width + 1, 0)
    return np.flatnonzero(doc[:m] == doc[width - 1 :]), np.flatnonzero((n > 0) & (n < width))


def _padded(values: np.ndarray, words: Words, short: np.ndarray, width: int, blank: int) -> np.ndarray:
    """The values of short texts' words, a row for each text, filled up with ``blank``."""
    at = words.first[short][:, None] + np.arange(width)
    return np.where(at < words.first[short + 1][:, None], values[np.minimum(at, max(len(values) - 1, 0))], values.dtype.type(blank))


def _distinct(owner: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return owner[new], shingles[new]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts, as rows (text, 64-bit shingle hash) in order."""
    words = split_words(column)
    hashes = words.hashes(_HASH, _FOLD)
    at, short = _shingled(words, width)
    few = _HASH.windows(_padded(hashes, words, short, width, 0).ravel(), width)[::width] if len(short) else np.zeros(0, np.uint64)
    return _distinct(np.concatenate([words.doc_of()[at], short]), np.concatenate([_HASH.windows(hashes, width)[at], few]))


def exact_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts, as rows (text, number of the shingle) in order: equal numbers, equal words."""
    words = split_words(column)
    numbers, many = words.numbers(_FOLD)
    at, short = _shingled(words, width)
    few = _padded(numbers, words, short, width, many) if len(short) else np.zeros((0, width), np.int64)
    shingles, size = np.zeros(len(at) + len(short), np.int64), 1
    for k in range(width):
        if size * (many + 1) >= 1 << 62:
            found, shingles = np.unique(shingles, return_inverse=True)
            size = len(found)
        shingles = shingles * (many + 1) + np.concatenate([numbers[at + k], few[:, k]])
        size *= many + 1
    return _distinct(np.concatenate([words.doc_of()[at], short]), shingles)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def _signed(texts: DataFrame, width: int) -> DataFrame:
    """``id, n, c1, c2, sig``: set size, the text's 128-bit digest (null for an empty set) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        circulant = Circulant()
        for batch in steps(batches, 1):
            owner, shingles = shingle_sets(batch.column(1), width)
            n = np.bincount(owner, minlength=batch.num_rows)
            data, offsets = column_bytes(batch.column(1))
            raw, edges = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            c1, c2 = (pa.array(c, mask=n == 0) for c in np.frombuffer(digests, "<i8").reshape(-1, 2).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), c1, c2, _fixed(circulant.signatures(owner, shingles, batch.num_rows))], names=["id", "n", "c1", "c2", "sig"])

    return texts.mapInArrow(lean(run), "id long, n long, c1 long, c2 long, sig binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, id``: each class in its 51 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                signatures = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, _COORDINATES)
                keys = band_keys(signatures)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(lean(run), "key long, id long")


def _with_texts(pairs: DataFrame, texts: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over ``a, b`` and both texts."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(lean(run), schema)


def _pair_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same pairs in slices of which first and second texts have about ``STEP_BYTES`` together."""
    return steps(steps(batches, 2, STEP_BYTES // 2), 3, STEP_BYTES // 2)


def _paired(batch: pa.RecordBatch) -> pa.Array:
    """First and second texts of a batch of pairs, in one column."""
    return pa.concat_arrays([batch.column(2), batch.column(3)])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _pair_steps(batches):
            owner, shingles = exact_sets(_paired(batch), width)
            size = np.bincount(owner, minlength=2 * batch.num_rows).reshape(2, -1).sum(0)
            owner = owner % batch.num_rows
            order = np.lexsort((shingles, owner))
            owner, shingles = owner[order], shingles[order]
            same = (owner[1:] == owner[:-1]) & (shingles[1:] == shingles[:-1])
            common = np.bincount(owner[1:][same], minlength=batch.num_rows)
            linked = pa.array((common > 0) & (100 * common >= percent * (size - common)))
            yield batch.select([0, 1]).filter(linked)

    return _with_texts(pairs, texts, run, "a long, b long")


def _distances(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``a, b, apart, open``: of each pair, how many shingles only one of a and b has, and how many
    of these stand in the difference of some other a from the same b, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _pair_steps(batches):
            owner, shingles = shingle_sets(_paired(batch), width)
            owner = owner % batch.num_rows
            order = np.lexsort((shingles, owner))
            owner, shingles = owner[order], shingles[order]
            same = (owner[1:] == owner[:-1]) & (shingles[1:] == shingles[:-1])
            alone = ~(np.append(same, False) | np.concatenate([[False], same]))[: len(owner)]
            owner, shingles = owner[alone], shingles[alone].view(np.int64)
            apart = np.bincount(owner, minlength=batch.num_rows)
            ids = batch.column(0).to_numpy()
            pair = pa.array(np.concatenate([owner, np.arange(batch.num_rows)]))
            sums = np.concatenate([np.zeros(len(owner), np.int64), apart])
            columns = [batch.column(0).take(pair), batch.column(1).take(pair), pa.array(np.concatenate([shingles, ids])), pa.array(sums), pa.array(np.arange(len(pair)) >= len(owner))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shingle", "apart", "whole"])

    # of each pair, a row for each shingle of its difference, and one for their number under the key a
    rows = _with_texts(pairs, texts, run, "a long, b long, shingle long, apart long, whole boolean")
    held = rows.groupBy("b", "whole", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("apart").alias("apart")).filter("whole or n = 1")
    own = F.count_if(~F.col("whole"))
    return held.groupBy("a", "b").agg(F.max("apart").alias("apart"), (F.max("apart") - own).alias("open"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members ``key, id, component`` of buckets with several components, with whether they are outside the largest one (``few``)."""
    tally = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = tally.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return checkpointed(members.join(shape.select("key", F.col("main.component").alias("main")), "key").withColumn("few", F.col("component") != F.col("main")).drop("main"))


#: What a block says of the members that it compares: see ``_compared``.
_Report = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _compared(rows: DataFrame, signed: DataFrame, percent: int, floor: float, report: _Report, schema: str) -> DataFrame:
    """What ``report(ids, x, y, alike, once)`` returns for members ``few`` of a bucket and its other members, of another component each.

    x and y are places of pairs in ``ids`` whose signatures agree in ``floor`` at least and whose numbers ``near, far`` leave room
    (with F = far of one and N = near of the other, F + N <= 0); once: the pair shares no earlier bucket. It is called for some
    of the members ``few`` at a time, with all pairs of each, so that a worker holds ``_PAIRS`` pairs or those of one member.
    """
    sizes = rows.groupBy("key").agg(F.count_if("few").alias("n_few"), F.count(F.lit(1)).alias("n_all")).filter("n_few > 0 and n_all > 1")
    sizes = sizes.select("key", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("n_few", "n_all")])
    rows = rows.join(sizes, "key")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ("key", "id", "component", "few", "near", "far")
    asking = rows.filter("few").select(*columns, part("n_few").alias("p"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("q"), F.lit(True).alias("asks"))
    asked = rows.select(*columns, F.explode(F.sequence(F.lit(0), F.col("n_few") - 1)).alias("p"), part("n_all").alias("q"), F.lit(False).alias("asks"))
    together = asking.unionByName(asked).join(signed.select("id", "sig"), "id").select("key", "p", "q", "asks", "few", "id", "component", "near", "far", "sig")
    names = [field.split()[0] for field in schema.split(", ")]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        asks, few = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        ids, parts, near, far = (batch.column(k).to_numpy() for k in (5, 6, 7, 8))
        signatures = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint16).reshape(-1, _COORDINATES)
        asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
        key = batch.column(0)[0].as_py()
        told: list[list[np.ndarray]] = []
        rows_at_once = max(1, _PAIRS // max(len(asked), 1))
        for at in range(0, max(len(asking), 1), rows_at_once):
            x = asking[at : at + rows_at_once]
            open_ = (parts[x][:, None] != parts[asked]) & (~few[asked] | (ids[x][:, None] < ids[asked]))
            open_ &= (far[x][:, None] + near[asked] <= 0) & (near[x][:, None] + far[asked] <= 0)
            i, j = np.nonzero(open_)
            x, y = x[i], asked[j]
            equal = signatures[x] == signatures[y]
            alike = equal.mean(1)
            close = alike >= floor
            x, y, shared = x[close], y[close], equal[close].reshape(-1, BANDS, ROWS).all(2)
            once = (band_keys(signatures[x]).view(np.int64) == key).argmax(1) == shared.argmax(1)
            told.append(report(ids, x, y, alike[close], once))
        columns = [np.concatenate(c) for c in zip(*told, strict=True)]
        if len(columns) == 1:  # members, which several calls may have told
            columns = [np.unique(columns[0])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            marks = [whole.column(k).to_numpy() for k in range(3)]
            edges = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            at = 0
            for edge in edges.tolist():
                yield block(whole.slice(at, edge - at))
                at = edge
            waiting = [whole.slice(at)]
        if waiting:
            yield block(waiting[0])

    return together.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(lean(run), schema)


def _likely(rows: DataFrame, signed: DataFrame, percent: int, floor: float, best: int) -> DataFrame:
    """Pairs ``a, b`` of members with the ``best`` most alike partners of each."""

    def report(ids: np.ndarray, x: np.ndarray, y: np.ndarray, alike: np.ndarray, once: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((-alike, x))
        first = order[np.arange(len(order)) - np.searchsorted(x[order], x[order]) < best]
        return [ids[x[first]], ids[y[first]], alike[first]]

    free = rows.withColumns({"near": F.lit(0).cast("long"), "far": F.lit(0).cast("long")})
    found = _compared(free, signed, percent, floor, report, "a long, b long, alike double").distinct()
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("alike"), "b"))).filter(F.col("r") <= best)
    return checkpointed(ranked.select("a", "b"))


def _doubtful(rows: DataFrame, signed: DataFrame, heads: DataFrame, texts: DataFrame, width: int, percent: int, floor: float) -> DataFrame:
    """Pairs ``a, b`` of members in different components that may be similar enough, all of them."""

    def members(ids: np.ndarray, x: np.ndarray, y: np.ndarray, alike: np.ndarray, once: np.ndarray) -> list[np.ndarray]:
        return [np.unique(ids[np.concatenate([x, y])])]

    def pairs(ids: np.ndarray, x: np.ndarray, y: np.ndarray, alike: np.ndarray, once: np.ndarray) -> list[np.ndarray]:
        return [ids[x[once]], ids[y[once]]]

    free = rows.withColumns({"near": F.lit(0).cast("long"), "far": F.lit(0).cast("long")})
    doubtful = checkpointed(_compared(free, signed, percent, floor, members, "id long").distinct())
    left = checkpointed(rows.join(doubtful, "id", "left_semi").join(heads.withColumnRenamed("b", "head"), "key"))
    stars = left.filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    far = checkpointed(_distances(stars, texts, width)).withColumnsRenamed({"a": "id", "b": "head"})
    known = left.join(far, ["id", "head"], "left").join(signed.select("id", "n"), "id").fillna(0, ["apart", "open"])
    # with S the sum of both sizes, a link needs |x ^ y| <= S * (100 - percent) / (100 + percent)
    size, weight = F.lit(100 - percent) * F.col("n"), F.lit(100 + percent)
    known = known.select("key", "id", "component", "few", (weight * F.col("apart") - size).alias("far"), (weight * (F.col("apart") - 2 * F.col("open")) - size).alias("near"))
    known = checkpointed(known)
    least = known.groupBy("key").agg(F.min("far").alias("far_all"), F.min("near").alias("near_all"), F.min(F.when(F.col("few"), F.col("far"))).alias("far_few"), F.min(F.when(F.col("few"), F.col("near"))).alias("near_few"))
    of = lambda c: F.when(F.col("few"), F.col(f"{c}_all")).otherwise(F.col(f"{c}_few"))
    open_ = known.join(least, "key").filter((F.col("far") + of("near") <= 0) & (F.col("near") + of("far") <= 0)).select(*known.columns)
    return checkpointed(_compared(checkpointed(open_), signed, percent, floor, pairs, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each input row."""
    texts = _keyed(docs, id_col, text_col)
    signed = checkpointed(_signed(texts, width))
    classes = checkpointed(
        signed.filter("c1 is not null").groupBy("c1", "c2").agg(F.min(F.struct("id", "n", "sig")).alias("one"))
        .select("c1", "c2", "one.id", "one.n", "one.sig")
    )
    buckets = _buckets(classes)
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = checkpointed(buckets.join(sizes, "key"))
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    heads = checkpointed(shared.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"), "id")).alias("head")).select("key", F.col("head.id").alias("b")))
    pairs = shared.join(heads, "key").select(F.col("id").alias("a"), "b").filter("a != b").distinct()
    known = checkpointed(texts.join(weight.select("id"), "id", "left_semi"))
    links = checkpointed(_verified(pairs, known, width, percent))
    now = components(links)
    limit = percent / 100
    floor = limit - SIGMAS * (limit * (1 - limit) / _COORDINATES) ** 0.5
    for last in (False, True):
        labels = now.withColumnRenamed("node", "id")
        seen = shared if last else shared.filter(F.pmod(F.xxhash64("key"), F.lit(4)) == 0)
        rows = _unsettled(seen.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
        if rows.isEmpty():
            continue
        signed_few = checkpointed(classes.select("id", "n", "sig").join(rows.select("id").distinct(), "id", "left_semi"))
        found = _doubtful(rows, signed_few, heads, known, width, percent, floor) if last else _likely(rows, signed_few, percent, floor, BEST)
        more = checkpointed(_verified(found, known, width, percent))
        if not more.isEmpty():
            now = components(now.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_class = classes.select("c1", "c2", F.col("id").alias("class_id"))
    reached = of_class.join(now.withColumnRenamed("node", "class_id"), "class_id", "left").select("c1", "c2", F.coalesce("component", "class_id").alias("component"))
    rows = signed.select("id", "n", "c1", "c2").join(reached, ["c1", "c2"], "left")
    real: Column = F.when(F.col("id") != _NO_ID, F.col("id"))
    component = F.coalesce("component", "id")
    return rows.select(real.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != _NO_ID, component).alias("component_id"), (F.col("id") == component).alias("kept"))
