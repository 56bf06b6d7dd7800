"""The queries opN_<name> of this package and their SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, exact_dedup, hard_negatives, language_id, line_dedup, packing, pitman_yor, revisit, simhash, text_fingerprints, url_filter, vector_search
from .common import table


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


#: The rules of the query's contract.
BLOCK, ALLOW = ["com/en/", "example.net/de/8", "org/es/"], ["example.com/en/7", "net/de/"]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")), BLOCK, ALLOW)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.text_scores(table(spark, sf_dir, "documents"))


def op2_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolved(revisit.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fingerprints.likenesses(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pitman_yor, op2_revisit, op3_line_dedup, op4_best_fit_packing, op5_byte_bpe, op6_language_id, op7_vector_search, op8_url_filter, op9_exact_dedup, op10_simhash, op11_hard_negatives, op12_fingerprints, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_revisit": revisit.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
