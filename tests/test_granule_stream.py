import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.fetchers import _rows
from tidemark.plans.partitions import PartitionTable
from tidemark.streaming.granules import ROW, granule_states, load_granules


@pytest.fixture
def log(tmp_path, monkeypatch, spark):
    (tmp_path / "log").mkdir()
    monkeypatch.setenv("FETCH_LOG", str(tmp_path / "log"))
    spark.conf.set("spark.sql.execution.pyspark.udf.faulthandler.enabled", "false")
    return tmp_path


def tables(spark, path):
    return PartitionTable(spark, str(path / "points"), ["granule", "time"], {"day": F.to_date("time")}), PartitionTable(spark, str(path / "status"), ["granule"], {"g": F.substring("granule", 1, 1)})


def run(spark, path, **more):
    load_granules(spark, str(path / "manifest"), "tests.fetchers:fetch", *tables(spark, path), str(path / "checkpoint"), batch=1, pause=0.01, **more).awaitTermination()


def test_failures_lose_and_double_nothing(spark, log):
    """Workers take the log's place from the names' folder: the environment of Spark's workers is that of the session."""
    import os

    spark.sparkContext.environment["FETCH_LOG"] = os.environ["FETCH_LOG"]
    manifest = log / "manifest"
    manifest.write_text("".join(f"g{i}\n" for i in range(1, 9)) + "g9")  # the last line is not whole yet
    run(spark, log, row=ROW, attempts=3)
    points, status = tables(spark, log)
    got = {r["granule"]: r for r in status.read().collect()}
    assert {g: r["status"] for g, r in got.items()} == {f"g{i}": "failed" if i == 3 else "empty" if i == 5 else "loaded" for i in range(1, 9)}
    assert got["g1"]["attempts"] == 3 and "no answer" in got["g3"]["error"]
    want = Counter({f"g{i}": len(_rows(f"g{i}")) for i in (1, 2, 4, 6, 7, 8)})
    assert Counter(r["granule"] for r in points.read().collect()) == want
    with manifest.open("a") as f:
        f.write("\ng11\n")
    run(spark, log, row=ROW, attempts=3)  # a new query from the checkpoint
    assert Counter(r["granule"] for r in tables(spark, log)[0].read().collect()) == want + Counter({"g9": len(_rows("g9")), "g11": len(_rows("g11"))})
    calls = Counter((log / "log/calls").read_text().split())
    assert calls == Counter({f"g{i}": 3 for i in [*range(1, 10), 11]})


T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_states_timers_and_restart(spark, tmp_path):
    source, out = tmp_path / "events", tmp_path / "out"

    def put(*events):
        spark.createDataFrame([(g, at(m), s) for g, m, s in events], "granule string, at timestamp, status string").coalesce(1).write.mode("append").parquet(str(source))

    key = lambda rows: sorted(rows, key=str)
    put(("a", 0, "pending"), ("a", 1, "fetched"), ("b", 0, "pending"), ("c", 2, "pending"), ("x", 1, "loaded"))
    first = [("a", None, "pending"), ("a", "pending", "fetched"), ("b", None, "pending"), ("c", None, "pending")]

    def seen():
        return key((r["granule"], r["before"], r["status"]) for r in spark.read.schema("granule string, at timestamp, status string, before string").parquet(str(out)).collect())

    def go():
        ev = spark.readStream.schema("granule string, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(source))
        granule_states(ev, wait_minutes=30, late="5 minutes").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    go()
    assert seen() == key(first)
    put(("a", 3, "loaded"), ("a", 3, "loaded"), ("a", 1, "fetched"), ("c", 4, "fetched"), ("c", 5, "empty"))  # replayed events change nothing
    go()
    second = first + [("a", "fetched", "loaded"), ("c", "pending", "fetched"), ("c", "fetched", "empty")]
    assert seen() == key(second)
    put(("d", 60, "pending"))  # time goes on: b has been pending for too long
    go()
    put(("d", 61, "fetched"))
    go()
    third = second + [("d", None, "pending"), ("b", "pending", "stuck"), ("d", "pending", "fetched")]
    assert seen() == key(third)
    put(("b", 62, "fetched"), ("b", 63, "loaded"))
    go()
    assert seen() == key(third + [("b", "stuck", "fetched"), ("b", "fetched", "loaded")])
