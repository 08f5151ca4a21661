"""Granules as a stream: a source that reads a growing manifest and fetches in batches with retries, and the state of each
granule, with timers for those that got stuck."""

from __future__ import annotations

import importlib
import sys
import time
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.plans.partitions import PartitionTable

#: What a fetched granule holds, if the caller does not say.
ROW = "rgt int, cycle int, time timestamp, lat double, lon double, height double"


class GranuleStream(DataSource):
    """spark.readStream.format("granule_stream"): a row for each granule of a manifest, a text file with a name in each
    line that only grows. Offsets count its lines, so a restart goes on where the checkpoint ended.

    Options: manifest; fetcher (module:function that takes a list of names and returns {name: rows}); batch (names fetched
    at once); attempts and pause (seconds before the second attempt; it doubles); row (schema of a granule's rows). A batch
    that fails to the end gives rows with status failed and the error; the stream goes on."""

    @classmethod
    def name(cls) -> str:
        return "granule_stream"

    def schema(self) -> str:
        return f"granule string, status string, attempts int, error string, rows array<struct<{self.options.get('row', ROW)}>>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Manifest(dict(self.options))


class _Batch(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Manifest(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.manifest, self.fetcher = options["manifest"], options["fetcher"]
        self.size, self.attempts, self.pause = int(options.get("batch", 50)), int(options.get("attempts", 4)), float(options.get("pause", 1.0))

    def _names(self) -> list[str]:
        with open(self.manifest, encoding="utf-8") as f:
            return [line.rstrip("\n") for line in f if line.endswith("\n")]  # a line that is being written waits

    def initialOffset(self) -> dict:
        return {"lines": 0}

    def latestOffset(self) -> dict:
        return {"lines": len(self._names())}

    def partitions(self, start: dict, end: dict):
        names = [n for n in self._names()[start["lines"] : end["lines"]] if n.strip()]
        return [_Batch(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [_Batch([])]

    def commit(self, end: dict) -> None:
        """Nothing to release: the manifest stays."""

    def read(self, partition) -> Iterator[tuple]:
        if not partition.names:
            return
        module, _, function = self.fetcher.partition(":")
        fetch, error = getattr(importlib.import_module(module), function), ""
        for attempt in range(1, self.attempts + 1):
            try:
                found = fetch(partition.names)
                break
            except Exception as e:  # whatever a remote service does
                error = f"{type(e).__name__}: {e}"
                if attempt < self.attempts:
                    time.sleep(self.pause * 2 ** (attempt - 1))
        else:
            yield from ((n, "failed", self.attempts, error, None) for n in partition.names)
            return
        for n in partition.names:
            rows = [tuple(r) for r in found.get(n) or []]
            yield n, "loaded" if rows else "empty", attempt, None, rows


def load_granules(spark: SparkSession, manifest: str, fetcher: str, points: PartitionTable, status: PartitionTable, checkpoint: str, *, row: str = ROW, **options) -> StreamingQuery:
    """Fetches what the manifest has new, merges the points and then the status of each granule, and stops.

    Both merges know the number of the micro-batch, so one that is replayed after a crash between them changes nothing
    twice. `points` has the columns of `row` and granule; `status` granule, status, attempts and error."""
    spark.dataSource.register(GranuleStream)
    stream = spark.readStream.format("granule_stream").option("manifest", manifest).option("fetcher", fetcher).option("row", row)
    for k, v in options.items():
        stream = stream.option(k, str(v))

    def load(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # fetched once for both
        try:
            points.merge(batch.select("granule", F.explode("rows").alias("r")).select("granule", "r.*"), batch=("granules", number))
            status.merge(batch.select("granule", "status", "attempts", "error"), order=[F.col("status") == "failed"], batch=("granules", number))
        finally:
            batch.unpersist()

    return stream.load().writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# states

#: What may follow what; other events of a granule change nothing, so replayed ones do not either.
NEXT = {None: ("pending",), "pending": ("fetched", "failed"), "fetched": ("loaded", "empty", "failed"), "failed": ("pending",), "stuck": ("pending", "fetched", "failed"), "loaded": (), "empty": ()}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GranuleStates(StatefulProcessor):
    """The state of one granule, by its events in order of time; while it is pending or fetched a timer runs."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("status", T.StringType()), T.StructField("due", T.LongType())]))

    def _now(self) -> tuple[str | None, int]:
        return tuple(self.state.get()) if self.state.exists() else (None, 0)

    def _enter(self, status: str, at_ms: int) -> None:
        _, due = self._now()
        if due:
            self.handle.deleteTimer(due)
        due = at_ms + self.wait_ms if status in ("pending", "fetched") else 0
        if due:
            self.handle.registerTimer(due)
        self.state.update((status, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["at"], r["status"])):
            before, _ = self._now()
            if r["status"] in NEXT[before]:
                self._enter(r["status"], int(r["at"].timestamp() * 1000))
                yield Row(granule=key[0], at=r["at"], status=r["status"], before=before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import datetime

        before, due = self._now()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if due == at:
            self.state.update(("stuck", 0))
            yield Row(granule=key[0], at=datetime.datetime.fromtimestamp(at / 1000), status="stuck", before=before)

    def close(self) -> None:
        """Nothing to close."""


def granule_states(events: DataFrame, *, wait_minutes: float = 60, late: str = "10 minutes") -> DataFrame:
    """granule, at, status, before: each change of state, from events (granule, at, status) in any order within `late`.

    A granule that stays pending or fetched for `wait_minutes` of event time becomes stuck, and may go on from there. States are
    in the RocksDB store, so their number is not bounded by memory; a restart goes on from the checkpoint."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = T.StructType([T.StructField("granule", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("before", T.StringType())])
    return events.withWatermark("at", late).groupBy("granule").transformWithState(GranuleStates(int(wait_minutes * 60_000)), out, "Append", "EventTime")


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
