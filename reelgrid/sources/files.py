"""Files as rows: content, kind, integrity. Nothing is decoded; what needs a codec is deferred."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binwalk
from ..operators import policy
from . import containers


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, for folders that only Spark reaches; containers.read() opens large ones by seeks."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def doc_type(content: Column) -> Column:
    @F.arrow_udf("string")
    def told(contents: pa.Array) -> pa.Array:
        return pa.array([binwalk.doc_type(binwalk.Held(c.as_buffer())) if c.is_valid else None for c in contents], pa.string())

    return told(content)


def gif_frames(content: Column) -> Column:
    """Images of a GIF; 0 where the bytes can't be read, 1 of a still."""

    @F.arrow_udf("int")
    def counted(contents: pa.Array) -> pa.Array:
        return pa.array([binwalk.gif_frames(binwalk.Held(c.as_buffer())) if c.is_valid else 0 for c in contents], pa.int32())

    return counted(content)


def probed(found: DataFrame) -> DataFrame:
    """path, kind by content, container by route: .mov, other native kinds as mp4, Matroska or WebM by DocType."""
    rows = found.select("path", binwalk.sniffed(F.col("content")).alias("kind"), doc_type(F.col("content")).alias("_doc"))
    route = F.when((F.col("kind") == "isobmff") & F.lower("path").endswith(".mov"), "mov").when(F.col("kind") == "isobmff", "mp4").when((F.col("kind") == "ebml") & (F.col("_doc") == "webm"), "webm").when(F.col("kind") == "ebml", "matroska").otherwise("none")
    return rows.select("path", "kind", route.alias("container"), policy.still_format(F.col("path")).alias("still_format"))


def judged(rows: DataFrame) -> DataFrame:
    """rows with checks: the verdict, and the diagnosis of the first failure."""
    return rows.select("path", "kind", "checks", policy.verdict(F.col("checks")).alias("verdict"), policy.first_failure(F.col("checks")).alias("failure"))


def verified(found: DataFrame) -> DataFrame:
    """path, kind, checks, verdict and the first failure of each row of bytes."""
    return judged(found.select("path", binwalk.sniffed(F.col("content")).alias("kind"), binwalk.checks(F.col("content")).alias("checks")))


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """As verified(), of files that are opened by seeks: headers are all that is read, but for PNG."""
    return judged(containers.read(spark, path))
