"""Media-shaped views of the driver's tables, for both engines: a function for Spark, text for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("lane"),
        F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string")).alias("name"),
        (micros("ts") * 1000).alias("start_ns"),
        (F.round(F.col("value") * 1e6).cast("long") * 1000).alias("dur_ns"),
        F.col("user_id").alias("tid"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 3).alias("detail"),
        F.when(F.col("event_id") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("user"), F.col("user_id").cast("string"))).alias("attrs"),
    )


SPANS = """spans AS (
  SELECT event_type AS lane, event_type || ':' || (user_id % 10) AS name, epoch_us(ts) * 1000 AS start_ns,
    CAST(round(value * 1e6) AS BIGINT) * 1000 AS dur_ns, user_id AS tid, event_id AS seq, event_id % 3 AS detail FROM events
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, idx, score): one clip per user, frames in the order of time."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(own) - 1).alias("idx"), F.col("value").alias("score"), micros("ts").alias("pts_us"))


SCORES = """scores AS (
  SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS score, epoch_us(ts) AS pts_us FROM events
)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, v): embeddings as 8 x 8 planes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("id", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("e").cast("double").alias("v"))


PLANES = """planes AS (
  SELECT id, (p - 1) // 8 AS y, (p - 1) % 8 AS x, CAST(e AS DOUBLE) AS v
  FROM (SELECT vec_id AS id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings)
)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w, h, fps, bps): sources with unknown rates among them."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("id"),
        (320 + (p * 37 % 40) * 80).alias("w"),
        (240 + (p * 53 % 30) * 60).alias("h"),
        F.element_at(F.array(*map(F.lit, (0.0, 24.0, 30.0, 60.0))), (p % 4 + 1).cast("int")).alias("fps"),
        (F.col("p_retailprice") * 1000 * (F.col("p_size") % 7)).alias("bps"),
    )


PROFILES = """profiles AS (
  SELECT p_partkey AS id, 320 + (p_partkey * 37 % 40) * 80 AS w, 240 + (p_partkey * 53 % 30) * 60 AS h,
    CASE p_partkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 24.0::DOUBLE WHEN 2 THEN 30.0::DOUBLE ELSE 60.0::DOUBLE END AS fps,
    p_retailprice * 1000 * (p_size % 7) AS bps FROM part
)"""

#: Codec names as containers carry them, some of them unknown to every list.
CODECS = ["V_MPEG4/ISO/AVC", "V_MPEGH/ISO/HEVC", "V_AV1", "V_MPEG2", "V_MPEG1", "V_VP9", "V_VP8", "A_OPUS", "A_FLAC", "A_ALAC", "A_AC3", "A_EAC3", "A_MPEG/L1", "A_MPEG/L3", "A_PCM/INT/LIT", "A_PCM/FLOAT/IEEE", "A_AAC", "A_AAC/MPEG4/LC", "A_VORBIS", "A_DTS", "avc1", " aac ", "hev1", "Opus", "mystery"]


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, codec, channels, rate, has_private)."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("id"), F.element_at(F.array(*map(F.lit, CODECS)), (n % len(CODECS) + 1).cast("int")).alias("codec"), (n % 3 * 2).alias("channels"), F.when(n % 4 == 0, 0.0).otherwise(44100.0).alias("rate"), (n % 2 == 0).alias("has_private"))


CODECS_SQL = f"""codecs AS (
  SELECT n_nationkey AS id, {CODECS!r}[n_nationkey % {len(CODECS)} + 1] AS codec, n_nationkey % 3 * 2 AS channels,
    CASE WHEN n_nationkey % 4 = 0 THEN 0.0::DOUBLE ELSE 44100.0::DOUBLE END AS rate, n_nationkey % 2 = 0 AS has_private FROM nation
)"""
