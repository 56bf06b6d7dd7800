"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in this package.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, set as the checkpoint folder too.

    Where that is unset, a session on one machine (tests) gets a temporary folder of its own; on a
    cluster nothing else is shared for certain, so that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelgrid-checkpoint-"))
    return context.getCheckpointDir().get()


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Rows written to the shared folder, in columns: lineage is cut, and they take less room than in a checkpoint.

    files: as many at most. Little data would otherwise make a task and a file for each shuffled part that the session names.
    """
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_in = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Remove the rows of frames from stored() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "stored_in", None):
            deleted(df.sparkSession, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells its rows apart and stays the same however often they are read.

    Rows read straight from files are known by (hash of the file's path, place in the file); others
    are written to the shared folder with a number.
    """
    plan, simple = docs._jdf.queryExecution().analyzed(), True
    while plan.children().size() == 1:
        simple &= plan.nodeName() in ("Project", "Filter", "SubqueryAlias")
        plan = plan.children().head()
    if simple and plan.children().isEmpty() and plan.nodeName().startswith("LogicalRelation"):
        try:
            return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
        except AnalysisException:  # no file source, or one without row numbers
            pass
    return stored(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))))


def parts_of_hot(docs: DataFrame, least: int = 16) -> int:
    """Parts in which one group's rows are summed up: about the root of the rows, so that neither a part nor the row of its sums is large."""
    return max(least, min(1 << 20, isqrt(max(1, text_bytes(docs) // 2048))))


#: Bytes of an Arrow batch of operators that move whole texts.
TEXT_BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts take TEXT_BATCH bytes on either side of a worker's pipe, unless the session names a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(TEXT_BATCH))


def released() -> None:
    """Give memory that this worker has freed back to the system; workers live on while other tasks run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def releasing(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """scan, for mapInArrow, with released() after the last batch."""

    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        released()

    return run


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def plan_bytes(df: DataFrame) -> int:
    """What Catalyst estimates for the rows of df, from file sizes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(docs: DataFrame) -> int:
    """About the bytes of docs' files; where Catalyst can't tell, as for rows in no file, half of the texts' bytes."""
    size = plan_bytes(docs)
    if size < 1 << 60:
        return size
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2


def parts_for(docs: DataFrame, bytes_each: int, least: int = 12) -> int:
    """A number of partitions that grows with the input."""
    return max(least, min(200_000, -(-text_bytes(docs) // bytes_each)))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


#: Rows up to which keys of rows are broadcast (16 bytes each); beyond it they meet in a shuffled join.
KEYS = 1 << 21


def text_key(text: str = "text") -> Column:
    """What tells the texts of one doc_id apart: rows are known by doc_id and this, which every task computes alike."""
    return F.xxhash64(text, F.lit("row"))


def others(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """(doc_id, key) of the rows that stays doesn't name."""
    some = stays.select(F.col("doc_id").alias("_id"), F.col("key").alias("_other"))
    return rows.select("doc_id", "key").join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_other")), "left_anti")


def rows_without(docs: DataFrame, keys: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows (doc_id, key) of gone; of rows alike in doc_id and text one stays.

    keys: (doc_id, key) of every row of docs.
    """
    own, other, key = (free_name(docs, x) for x in ("_key", "_other", "_id"))
    marked = docs.withColumn(own, text_key())

    def met(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias(key), F.col("key").alias(other))
        some = F.broadcast(some) if some.count() <= KEYS else some
        return rows.join(some, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(other)), how)

    left = met(marked, gone, "left_anti")
    repeated = stored(keys.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    if repeated.isEmpty():
        return left.drop(own)
    return met(left, repeated, "left_anti").unionByName(met(left, repeated, "left_semi").dropDuplicates(["doc_id", own])).drop(own)
