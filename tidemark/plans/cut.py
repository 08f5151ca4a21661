"""Lineage cuts of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed now and kept in spark.checkpoint.dir, so that a lost executor costs nothing that came before.

    Where that is unset, a local master takes a folder of its own (tests); a cluster is refused."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="tidemark-cut-"))
    return df.checkpoint()
