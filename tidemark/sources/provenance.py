"""Digests of folders, as trees: chunks, files of chunks, a folder of files.

A chunk is CHUNK bytes wherever it lies, so a large file is many tasks and a small one shares a task with others; the
digests do not depend on how Spark deals them. Files are opened by path, on folders that all machines have.
"""

from __future__ import annotations

import hashlib
import os
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk. A part of the digest: another size gives other digests.
CHUNK = 4 << 20


def _digested(root: str, chunk: int):
    def run(batches):
        for batch in batches:
            out = []
            for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{root}/{name}", "rb") as f:
                    f.seek(i * chunk)
                    out.append(hashlib.sha256(f.read(chunk)).hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=["file", "chunk", "size", "digest"])

    return run


def chunk_digests(spark: SparkSession, folder: str, *, chunk: int = CHUNK) -> DataFrame:
    """file (below the folder), chunk, size (of the file) and digest of each chunk; an empty file is one empty chunk. Links and hidden files are files like others."""
    root = os.path.abspath(folder)
    found = [(os.path.relpath(p, root), os.path.getsize(p)) for d, _, names in os.walk(root) for n in names if os.path.isfile(p := f"{d}/{n}")]
    files = spark.createDataFrame(found, "file string, size long")
    rows = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / chunk) - 1))).alias("chunk"), "size")
    return rows.repartition("file", "chunk").mapInArrow(_digested(root, chunk), "file string, chunk long, size long, digest string")


def file_digests(chunks: DataFrame) -> DataFrame:
    """file, size and digest: that of its chunks' digests in order."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda c: c["digest"])
    return chunks.groupBy("file", "size").agg(F.sha2(F.concat_ws("", order), 256).alias("digest"))


def folder_digest(files: DataFrame) -> DataFrame:
    """One row: files, bytes and the digest of all names, sizes and digests in the order of the names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file", "size", "digest"))), lambda f: F.concat_ws("\t", f["digest"], f["size"].cast("string"), f["file"]))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws("\n", lines), 256).alias("digest"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two tables of chunk digests: each file that was added, removed or changed, and the first and number of its changed chunks."""
    a, b = (t.select("file", "chunk", F.struct("digest", "size").alias(n)) for t, n in ((before, "a"), (after, "b")))
    both = a.join(b, ["file", "chunk"], "full").groupBy("file").agg(
        F.count("a").alias("had"), F.count("b").alias("has"), F.min(F.when(~F.col("a.digest").eqNullSafe(F.col("b.digest")), F.col("chunk"))).alias("first_chunk"), F.count_if(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).alias("chunks")
    )
    kind = F.when(F.col("had") == 0, "added").when(F.col("has") == 0, "removed").otherwise("changed")
    return both.where("chunks > 0").select("file", kind.alias("change"), "first_chunk", "chunks")


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
