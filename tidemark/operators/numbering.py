"""Row numbers over a whole table without one task that sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.cut import cut


def numbered(df: DataFrame, order: list, out: str = "row_number") -> DataFrame:
    """Adds the rows' numbers from 1 in `order`, which should break ties.

    Rows are dealt by ranges of the order, kept, and numbered within each range; a range's first number follows from the
    sizes of those before it. The table of ranges has a row for each partition."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_within", within).join(F.broadcast(sizes), "_part").withColumn(out, F.col("_first") + F.col("_within")).drop("_part", "_within", "_first")
