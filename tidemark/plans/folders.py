"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below one of our own where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{uuid.uuid4().hex}"


def local_folder(spark: SparkSession) -> str:
    """The same as a path for open(), where the shared folder is mounted on all machines."""
    path = shared_folder(spark)
    if "://" in path and not path.startswith("file:///"):
        raise ValueError(f"{path} cannot be opened by path")
    return path.removeprefix("file://").removeprefix("file:")
