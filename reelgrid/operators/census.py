"""Census of repeated runs: do the same bytes come out again, and if not, how far apart are they.

A sequence's digest is put together from its elements by bit_xor of hashes of (place, element), under
two seeds: it depends on the order, has partial sums, and no sequence is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, bytes, sync_frames and digest of each run of samples (keys, place, size, sync)."""
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), "place", "size")) for seed in ("first", "second")]
    digest = F.concat_ws("-", F.count("*").cast("string"), *[F.lpad(F.hex(h), 16, "0") for h in hashed])
    return samples.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.count_if("sync").alias("sync_frames"), digest.alias("digest"))


def repeats(of: DataFrame, source: list[str]) -> DataFrame:
    """For each source: runs, spread of bytes (and in millionths of the smallest run), distinct frame counts and sequences, and whether all repeat."""
    spread = F.max("bytes") - F.min("bytes")
    return of.groupBy(*source).agg(
        F.count("*").alias("runs"), spread.alias("spread"), F.round(F.try_divide(spread, F.min("bytes")) * 1e6, 1).alias("ppm"),
        F.count_distinct("frames").alias("frame_counts"), F.count_distinct("digest").alias("sequences"), (F.count_distinct("digest") == 1).alias("repeats"),
    )
