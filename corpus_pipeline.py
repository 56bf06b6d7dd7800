"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, and work on all rows that the stage before it kept. Null, empty and very long texts,
null and repeated ids, repeated rows and further columns are defined by the operators' own modules: a
null or empty text is rejected by the first stage, of equal or near texts one row stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import exact_dedup, language_id, near_copies, packing
from reelgrid.llm.common import deleted, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    return language_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the longest, then the one with the smallest id."""
    return exact_dedup.exact_kept(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of 5-word shingles are alike by 0.8 or more the document with the smallest id.

    The closest copies meet in the SimHash trie self-join, all others by prefixes of their sets.
    """
    return near_copies.near_kept(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("best_fit_packing", packed)]

#: SQL can express neither the language model, the fingerprints nor the tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, then removed, but for the last's."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
