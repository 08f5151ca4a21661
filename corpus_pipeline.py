"""A corpus from documents: quality, lines, near-duplicates, benchmark leaks, mixture. Each stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.lines import dedup_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.quality import resample, row_key
from tidemark.llm.scratch import Scratch

#: Share of the tokens that the mixture keeps.
KEEP = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    scored = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    return rows.join(scored.where("kept").select("row_key").distinct(), "row_key", "left_semi").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; n_chars follows the text."""
    rows = dedup_lines(docs, short=True).select("row", "kept")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target marginals."""
    return mix(docs, keep=KEEP).where("kept").select("row.*")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: Raking and resampling iterate to a fit, which SQL does not express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "corpus"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
