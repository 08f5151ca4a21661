"""Operator 2: byte strings of 200 bytes that occur twice are cut from all documents that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.repeats import remove_repeats


def dedup_bytes(docs: DataFrame, width: int = 200, *, slices: int = 4, keep_text: bool = True) -> DataFrame:
    """Removes each byte covered by a `width`-byte string that also starts elsewhere, overlaps and same text included.

    Strings never cross documents and are judged on the input. Rows as those of remove_repeats()."""
    return remove_repeats(docs, "byte", width, "any", gram=max(1, width // 2), slices=slices, keep_text=keep_text)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
