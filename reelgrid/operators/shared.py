"""Rows that are kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in spark.checkpoint.dir; where that is unset, a session on one machine takes a temporary folder."""
    spark = rows.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelgrid-checkpoint-"))
    return rows.checkpoint(eager=True)
