"""Incremental loads with Structured Streaming: files that were not seen, in micro-batches, merged by key; and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.plans.store import Store


def ingest(spark: SparkSession, source: str, schema: str, store: Store, table: str, checkpoint: str, *, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 50, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Loads what is new under `source` and stops. The checkpoint knows the files that were loaded, and a batch that is
    replayed after a crash merges to the same table, so each row counts once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def load(batch: DataFrame, batch_id: int) -> None:
        store.merge(table, transform(batch) if transform else batch, partition_by=partition_by)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute_touched(points: DataFrame, touched: DataFrame, keys: list[str], levels: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Levels of the passes that a batch touched, from all their points and not from the batch's alone."""
    return levels(points.join(touched.select(*keys).distinct(), keys, "left_semi"))


def window_counts(events: DataFrame, *, ts="ts", key="event_type", value="value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark no longer count. For streams and tables."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("_ts", size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, *, ts="ts", key="user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of a key's events without a pause of `gap`."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), "n")
