"""Sinks: Parquet, CSV, JSON lines, text grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def raw_frame(df: DataFrame, run: str, batch: int) -> DataFrame:
    """Rows as they came, with the run and batch that brought them."""
    return df.withColumns({"run": F.lit(run), "batch": F.lit(batch)})


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """A result table as one CSV file with a head; for small tables."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def esri_lines(grid: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Rows of an ESRI ASCII grid from the north, each one line (row, value)."""
    cell = F.format_string("%.6f", F.coalesce("value", F.lit(nodata)))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", cell.alias("v")))), lambda x: x["v"]), " ")
    return grid.groupBy("iy").agg(row.alias("value")).orderBy(F.desc("iy"))
