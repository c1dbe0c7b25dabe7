"""Exact deduplication: 128-bit content hash groups, compared byte by byte.

Rows are grouped by the MD5 of their text and, within a hash, by the text itself: Spark
finds a row's group by the hash and compares bytes there, so texts with clashing hashes
are groups of their own. Each text is sent once, after the copies of a task are combined, so
that a text copied a billion times sends one row a task. A group keeps one row, by default the
one with the largest id (``keep="min"`` keeps the smallest).

Defined cases: a null text counts as empty. A null id stays only if the whole group has none.
Rows that repeat both id and text are one document: ``label_copies`` says the same of each, ``keep_one``
returns one, the last (first) by its other columns in their order, which must be of types that can be ordered. An
empty table gives an empty result. Columns besides id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Digest = Callable[[Column], Column]


def md5_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col], F.lit(""))


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Digest = md5_digest) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Rows find their group by both digests, so texts don't move a second time.
    """
    best = {"max": F.max, "min": F.min}[keep]
    text = _text(docs, text_col)
    rows = docs.select(digest(text).alias("h"), text.alias("content"), docs[id_col].alias("id"))
    groups = rows.groupBy("h", "content").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    each = docs.select(docs[id_col].alias("id"), digest(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    return each.join(groups, ["h", "text_sha256"]).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Digest = md5_digest) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    text, number = _text(docs, text_col), docs[id_col]
    best, known = (F.max, number.isNotNull()) if keep == "max" else (F.min, number.isNull())
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(known.alias("k"), number.alias("i"), F.struct(*[docs[c] for c in others]).alias("o"), docs[text_col].isNull().alias("none"))
    kept = docs.select(digest(text).alias("h"), text.alias("content"), row.alias("row")).groupBy("h", "content").agg(best("row").alias("row"))
    whole = {text_col: F.when(~F.col("row.none"), F.col("content"))}
    return kept.select(*[whole.get(c, F.col("row.o").getField(c)).alias(c) for c in docs.columns])
