"""Operator 8: windows of 50 words that an earlier document holds are cut from later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.repeats import remove_repeats


def dedup_windows(docs: DataFrame, width: int = 50, *, keep_text: bool = True) -> DataFrame:
    """Removes each word covered by a `width`-word window whose words also start in a document of smaller id.

    Rabin-Karp hashes of the windows are counted by range of the hash; marked windows merge into maximal intervals.
    Rows as those of remove_repeats()."""
    return remove_repeats(docs, "word", width, "smaller", gram=max(1, width // 2), keep_text=keep_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")
