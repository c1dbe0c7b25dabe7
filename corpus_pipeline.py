"""A corpus pipeline over ``documents``: STAGES in order, each a function (spark, docs, sf_dir).

All stages but the last return the columns of documents: language ID drops texts
without a language, exact dedup keeps one row of equal texts, MinHash near-dedup one
document of each component (five-word shingles, similarity 0.8), substring dedup
removes words in repeated windows of 35 words from the texts it finds them in, and
packing returns the pieces of token sequences with their places.

Defined cases, for all stages: an empty table gives an empty result; columns besides ``doc_id`` and ``text`` may have any
names and pass through; null ids are kept. Texts that are null or have no letter go with language ID. Rows that
repeat another one go with exact dedup, all but one. Ids are to be unique after that: near-dedup keeps all rows of an
id or none. A text of which nothing is left after substring dedup is empty and packs as its end id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import exact_dedup, language_id, minhash, packing, substring_dedup
from starloom.session import read_table, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs, width=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs, window=35)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed),
]

#: Language ID and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
