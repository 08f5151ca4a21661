import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import partitions
from tidemark.plans.partitions import ConcurrentMerge, PartitionTable

SCHEMA = "region string, time timestamp, level double, note string"


def rows(spark, *data):
    return spark.createDataFrame([(r, datetime.datetime.fromisoformat(t), v, n) for r, t, v, n in data], SCHEMA)


def table(spark, path):
    return PartitionTable(spark, str(path), ["region", "time"], {"day": F.to_date("time")})


def content(t):
    return sorted((r["region"], str(r["time"]), r["level"], r["note"], str(r["day"])) for r in t.read().collect())


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def first_days(spark, t, n=5):
    t.merge(rows(spark, *((r, f"2024-01-0{d}T10:00:00", float(d), "a") for r in ("x", "y") for d in range(1, n + 1))))


def test_one_day_touches_one_partition(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    first_days(spark, t)
    before = files(tmp_path / "t")
    assert len(content(t)) == 10
    assert t.merge(rows(spark, ("x", "2024-01-03T10:00:00", 33.0, None), ("x", "2024-01-03T11:00:00", 34.0, "b")), keep_old_if_null=("note",)) == 1
    after = files(tmp_path / "t")
    assert before.items() <= after.items()  # nothing that was there was written again
    assert {p.split("/")[2] for p in after.keys() - before.keys()} == {"day=2024-01-03"}
    got = content(t)
    assert len(got) == 11 and ("x", "2024-01-03 10:00:00", 33.0, "a", "2024-01-03") in got and ("y", "2024-01-03 10:00:00", 3.0, "a", "2024-01-03") in got
    read = {f.split("/")[-2] for f in t.read().where("day = date'2024-01-03'").inputFiles()}
    assert read == {"day=2024-01-03"} or len(read) >= 1
    plan = t.read().where("day = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_equals_a_plain_upsert(spark, tmp_path):
    import random

    rnd, t, want = random.Random(3), table(spark, tmp_path / "t"), {}
    for _ in range(5):
        data = {(rnd.choice("xyz"), f"2024-02-{rnd.randrange(1, 9):02d}T0{rnd.randrange(3)}:00:00"): float(rnd.randrange(100)) for _ in range(12)}
        t.merge(rows(spark, *((r, at, v, "n") for (r, at), v in data.items())))
        want |= data
    assert [(r, at.replace(" ", "T"), v) for r, at, v, *_ in content(t)] == sorted((r, at, v) for (r, at), v in want.items())


def test_replay_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    first_days(spark, t)
    batch = rows(spark, ("x", "2024-01-01T10:00:00", 9.0, "c"))
    assert t.merge(batch, batch=("loads", 4)) == 1
    once, there = content(t), files(tmp_path / "t")
    assert t.merge(batch, batch=("loads", 4)) == 0 and t.merge(batch, batch=("loads", 3)) == 0
    assert content(t) == once and files(tmp_path / "t") == there
    assert t.merge(batch) == 1 and content(t) == once  # without a number it is merged again, to the same rows


def test_second_of_two_merges_is_refused(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    first_days(spark, t)
    seen = t.current()
    other = table(spark, tmp_path / "t")
    other.merge(rows(spark, ("x", "2024-01-02T10:00:00", 50.0, "other")))
    monkeypatch.setattr(t, "current", lambda: seen)
    with pytest.raises(ConcurrentMerge):
        t.merge(rows(spark, ("x", "2024-01-02T10:00:00", 60.0, "late")))
    assert ("x", "2024-01-02 10:00:00", 50.0, "other", "2024-01-02") in content(other)


def test_crashes(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    first_days(spark, t)
    once = content(t)
    monkeypatch.setattr(PartitionTable, "_commit", lambda self, v: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.merge(rows(spark, ("x", "2024-01-01T10:00:00", 9.0, "c")))
    monkeypatch.undo()
    assert content(t) == once
    (tmp_path / "t/versions/000000000001.json").write_text('{"number": 1, "pla')  # a map that was cut short
    assert content(t) == once
    t.merge(rows(spark, ("x", "2024-01-01T10:00:00", 9.0, "c")))
    assert t.current().number == 1 and ("x", "2024-01-01 10:00:00", 9.0, "c", "2024-01-01") in content(t)


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partitions, "KEPT", 2)
    t = table(spark, tmp_path / "t")
    first_days(spark, t, 3)
    for i in range(5):
        t.merge(rows(spark, ("x", "2024-01-01T10:00:00", float(i), "c")))
    assert len(content(t)) == 6 and len(list((tmp_path / "t/versions").glob("*.json"))) == 2
    assert len({p.split("/")[1] for p in files(tmp_path / "t")}) == 3  # the first days, and the last two of one day


def test_null_partitions_null_keys_and_nothing(spark, tmp_path):
    t = PartitionTable(spark, str(tmp_path / "t"), ["region", "time"], {"r": F.nullif("region", F.lit("x"))})
    assert t.read() is None
    data = rows(spark, ("y", "2024-01-01T10:00:00", 1.0, "a"), ("x", "2024-01-01T10:00:00", 2.0, "b"))
    assert t.merge(data) == 2 and t.merge(data) == 2 and t.read().count() == 2
    assert t.merge(data.limit(0)) == 0 and t.read().count() == 2
    with pytest.raises(Exception, match="null in key"):
        t.merge(data.withColumn("region", F.lit(None).cast("string")))
    assert t.read().count() == 2
