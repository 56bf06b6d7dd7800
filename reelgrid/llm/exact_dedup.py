"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is normalised by deleting ASCII white space, then its UTF-8 bytes are cut where its own code
points say so (CHUNK), in every script alike. Chunks become identifiers, and documents are compared as
ordered lists of identifiers, so a long text is moved once at most, as chunks for verification, and never again.

An identifier is the chunk's SHA-256. The distinct (digest, chunk) pairs are brought together
once; a digest that stands for two different chunks is replaced, in every recipe, by the digest
followed by the chunk itself, so equal lists always mean equal texts. (Of such digests, of which none
is known, at most CLASHES reach the driver; more are an error.)

Defined results: a null text counts as empty; empty texts are equal to each other; a null doc_id
loses ties; of fully repeated rows exactly one stays; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, numbered, parts_of_hot, stored


def _last(remainder: int) -> str:
    """The last byte of a code point that leaves this remainder modulo 8."""
    return "[" + "".join(f"\\x{c:02X}" for c in range(remainder, 0xC0, 8)) + "](?![\\x80-\\xBF])"


#: The first bytes of a code point, if it has more than one.
_LEAD = r"(?:[\xC0-\xFF][\x80-\xBF]{0,2})?"
#: At least 512 and about 8192 bytes at most, ending at the first place from there on where three code
#: points have given remainders modulo 8; what is left at the end is a chunk too.
CHUNK = f"(?s).{{512,8189}}?{_last(1)}{_LEAD}{_last(4)}{_LEAD}{_last(7)}|.{{1,8192}}"
#: Digests of several chunks that may reach the driver; SHA-256 has none that are known.
CLASHES = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(normal: Column) -> Column:
    """The chunks of a text, each byte of its UTF-8 form written as one character."""
    one_to_one = F.when(F.octet_length(normal) == F.char_length(normal), normal).otherwise(F.decode(F.encode(normal, "UTF-8"), "ISO-8859-1"))
    return F.regexp_extract_all(one_to_one, F.lit(CHUNK), F.lit(0))


def clashing_digests(docs: DataFrame) -> DataFrame:
    """The digests (_digest) that more than one distinct chunk has."""
    return (
        docs.select(F.explode(chunks(normalised(F.col("text")))).alias("_chunk"))
        .select("_chunk", F.unhex(F.sha2(F.col("_chunk"), 256)).alias("_digest"))
        .groupBy("_digest", "_chunk").agg(F.lit(1).alias("_one"))
        .groupBy("_digest").agg(F.count("*").alias("_contents"))
        .where("_contents > 1").select("_digest")
    )


def recipes(docs: DataFrame) -> DataFrame:
    """_row, doc_id, text_sha256, code points (_points) and the ordered identifiers (_recipe) of each row of docs (_row, doc_id, text).

    They are computed once and written, narrow, to the shared folder.
    """
    clashing = [r["_digest"] for r in clashing_digests(docs).take(CLASHES + 1)]
    if len(clashing) > CLASHES:
        raise ValueError("SHA-256 gives many chunks one digest")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    told = F.array(*[F.lit(bytes(x)) for x in clashing])
    exact = lambda c: F.when(F.array_contains(told, digest(c)), F.concat(digest(c), c.cast("binary"))).otherwise(digest(c))
    rows = docs.select("_row", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_points"), normalised(F.col("text")).alias("_normal"))
    return stored(
        rows.select(
            "_row", "doc_id", "_points", F.sha2("_normal", 256).alias("text_sha256"),
            F.transform(chunks(F.col("_normal")), exact if clashing else digest).alias("_recipe"),
        )
    )


def last_first(best: str) -> Column:
    """The order in which rows of a group stay: most code points, then the smallest doc_id (null last), then the first row."""
    return F.struct((-F.col("_points")).alias("_points"), F.col("doc_id").isNull().alias("_null"), "doc_id", "_row").alias(best)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest doc_id, is kept. Groups are
    summed up in parts, whose number grows with the input, so that a text that a third of all rows
    share is not one task.
    """
    parts = F.lit(parts_of_hot(docs))
    rows = recipes(numbered(docs.select("doc_id", "text"), "_row")).withColumn("_part", F.pmod(F.hash("_row"), parts))
    by_part = rows.groupBy("_recipe", "_part").agg(F.count("*").alias("_n"), F.min(last_first("_best")).alias("_best"))
    group = Window.partitionBy("_recipe")
    told = by_part.select("_recipe", "_part", F.sum("_n").over(group).alias("group_size"), F.min("_best").over(group).alias("_best"))
    return rows.join(told, ["_recipe", "_part"]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def exact_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Rows that repeat each other in doc_id and text are reduced to one, like any equal texts.
    """
    key = free_name(docs, "_row")
    marked = numbered(docs, key)
    rows = recipes(marked.select(F.col(key).alias("_row"), "doc_id", "text"))
    part = F.pmod(F.hash("_row"), F.lit(parts_of_hot(docs))).alias("_part")
    stays = rows.groupBy("_recipe", part).agg(F.min(last_first("_best")).alias("_best")).groupBy("_recipe").agg(F.min("_best").alias("_best"))
    return marked.join(stays.select(F.col("_best._row").alias(key)), key, "left_semi").drop(key)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents
), r AS (
  SELECT doc_id, sha256(normal) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY normal ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY normal) AS group_size,
    row_number() OVER (PARTITION BY normal ORDER BY points DESC, doc_id) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
