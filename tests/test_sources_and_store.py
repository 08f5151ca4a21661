import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.store import Store, set_granules, upsert_region
from tidemark.sources import readers, sinks
from tidemark.streaming.ingest import ingest


def test_granules(spark, tmp_path):
    (tmp_path / "seed.txt").write_text(" ATL13_20190401044830_00450301_007_01.h5 \n# note\n\nATL08_20210507162458_06701102_007_01.h5\nbad.h5\n")
    names = readers.granule_names(spark, str(tmp_path / "seed.txt"))
    rows = readers.select_granules(names).collect()
    assert [(r["product"], r["rgt"], r["cycle"]) for r in rows] == [("ATL13", 45, 3), ("ATL08", 670, 11)]
    assert readers.select_granules(names, start="2020-01-01", product="ATL08").count() == 1
    m = readers.manifest(names, names.where("granule like 'ATL08%'"))
    assert {r["source"] for r in m.collect()} == {"seed", "seed+cmr"}


def test_normalised(spark):
    raw = spark.createDataFrame([(3.4e38, 1.5, 50, "POINT (34.5 47.25)", 7), (2.0, 3.4e38, 7, None, 8)], "water_depth float, ht_ortho float, gt int, geometry_wkt string, segment_id_beg int")
    schema = T._parse_datatype_string("lat double, lon double, water_depth_m double, h double, beam string, segment_id int, refid int")
    out = readers.normalised(raw, {"water_depth": "water_depth_m", "ht_ortho": "h", "segment_id_beg": "segment_id", "segment_id": "segment_id"}, schema, masks=("water_depth_m", "h")).collect()
    assert tuple(out[0]) == (47.25, 34.5, None, 1.5, "gt3l", 7, None) and out[1]["h"] is None and out[1]["beam"] == "7"


def test_gauges(spark):
    raw = spark.createDataFrame([("2020-06-01 08:00:00", "123"), ("x", "1"), ("2020-06-02 08:00:00", "n/a")], "`Дата` string, Level string")
    r = readers.gauge_series(raw, "s", zone="Europe/Kyiv", scale=0.01, zero=10.0).collect()
    assert len(r) == 1 and r[0]["stage_m"] == pytest.approx(1.23) and r[0]["wse_m"] == pytest.approx(11.23) and r[0]["datetime"].hour == 5
    daily = spark.createDataFrame([("s", datetime.date(2020, 1, 1), 100.0, None, 90.0)], "station_id string, date date, h_08 double, h_20 double, h_mean double")
    t = readers.term_readings(daily, zone="Europe/Kyiv", hours={"h_08": 8, "h_20": 20}).collect()
    assert len(t) == 1 and t[0]["datetime"].hour == 6
    assert readers.term_readings(daily.drop("h_08", "h_20"), zone="UTC", hours={"h_08": 8}).first()["stage_m"] == pytest.approx(0.9)


def test_stitching(spark):
    rows = [("p", "2020-01-01", 1056.0, "yearbook"), ("p", "2020-01-01", 999.0, "reservoir"), ("p", "2020-01-02", 5.0, "other")]
    out = readers.stitched(spark.createDataFrame(rows, "station_id string, date string, value double, source string"), breach="2020-01-02").orderBy("date").collect()
    assert [(r["value"], r["post_breach"]) for r in out] == [(1056.0, False), (5.0, True)]
    files = [("p", "2020-01-01", "level", 490.0, "a/version=1/daily/x"), ("p", "2020-01-01", "level", 999.0, "a/tmp_1/daily/x"), ("p", "2020-01-15", "level", 1.0, "a/version=1/monthly/x"), ("q", "2020-01-15", "level", 2.0, "a/version=1/monthly/x")]
    got = {(r["post_id"], r["value"]) for r in readers.versioned(spark.createDataFrame(files, "post_id string, date string, variable string, value double, path string")).collect()}
    assert got == {("p", 490.0), ("q", 2.0)}
    wide = spark.createDataFrame([(30, 1.0, 2.0), (1, None, 3.0)], "day int, m01 double, m02 double")
    assert {str(r["date"]) for r in readers.yearbook_grid(wide, 2021, ["m01", "m02"]).collect()} == {"2021-01-30", "2021-02-01"}


ESRI = "ncols 4\nnrows 3\nxllcorner 33.0\nyllcorner 46.0\ncellsize 0.5\nNODATA_value -9999\n-9999 0.11 0.12 0.13\n0.14 0.15 0.16 0.17\n0.10 0.18 0.12 0.12\n"
ISG = "begin_of_head\nlat min = 46°00'00\"\nlat max = 47°00'00\"\nlon min = 33°00'00\"\nlon max = 34°30'00\"\ndelta lat = 0°30'00\"\ndelta lon = 0°30'00\"\nnrows = 2\nncols = 3\nnodata = -9999.0\nend_of_head ====\n1 2 3\n4 5 -9999.0\n"


def test_grids(spark, tmp_path):
    (tmp_path / "a.asc").write_text(ESRI)
    (tmp_path / "b.isg").write_text(ISG)
    g = readers.read_grids(spark, str(tmp_path)).collect()
    a = {(r["iy"], r["ix"]): r for r in g if r["file"] == "a.asc"}
    assert a[2, 0]["value"] is None and a[0, 0]["value"] == 0.10 and a[0, 0]["lat"] == pytest.approx(46.25) and sum(r["value"] is not None for r in a.values()) == 11
    b = {(r["iy"], r["ix"]): r for r in g if r["file"] == "b.isg"}
    assert b[1, 0]["value"] == 1.0 and b[0, 2]["value"] is None and b[0, 0]["lat"] == pytest.approx(46.25)


def rows_for(names):
    return [(n, 1, 1, None, 0.0, 0.0, 1.0) for n in names]


def test_granule_source(spark):
    spark.dataSource.register(readers.GranuleBatches)
    d = spark.read.format("granules").option("names", "a,b,c").option("batch", "2").option("fetcher", "tests.test_sources_and_store:rows_for").load()
    assert sorted(r["granule"] for r in d.collect()) == ["a", "b", "c"] and d.rdd.getNumPartitions() == 2


def test_regions(spark):
    r = spark.createDataFrame([("a", "lake", "egm2008", [33.0, 46.0, 34.0, 47.0], None), ("b", "sea", None, [34.0, 46.0, 33.0, 47.0], None), ("c", "river", "egg2015", None, None)], "slug string, kind string, vertical string, bbox array<double>, polygon string")
    assert {(x["slug"], x["error"]) for x in readers.region_errors(r).collect()} == {("b", "kind"), ("b", "vertical"), ("b", "bbox"), ("c", "area")}
    assert readers.region_registry(r.where("slug = 'a'"), r).count() == 3
    assert readers.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_store_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    rows = lambda *r: spark.createDataFrame(r, "region string, product string, granule string, status string, n_rows int, raw_uri string")
    for _ in range(2):
        set_granules(store, rows(("r", "ATL13", "g1", "fetched", 5, "u"), ("r", "ATL13", "g2", "pending", None, None)))
    set_granules(store, rows(("r", "ATL13", "g1", "loaded", None, None)))
    got = {r["granule"]: (r["status"], r["n_rows"], r["raw_uri"]) for r in store.read("granules").collect()}
    assert got == {"g1": ("loaded", 5, "u"), "g2": ("pending", None, None)}
    reg = lambda o, d: spark.createDataFrame([("s", o, d)], "slug string, owner string, definition string")
    for owner, d in (("me", "1"), ("you", "2"), ("me", "3")):
        upsert_region(store, reg(owner, d))
    assert store.read("regions").first()["definition"] == "3"
    upsert_region(store, reg(None, "4"))
    assert store.read("regions").first()["definition"] == "3"


def test_stream_ingest(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "region string, beam string, time int, v double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    store = Store(spark, str(tmp_path / "db"))
    run = lambda: ingest(spark, src, schema, store, "points", str(tmp_path / "cp"), files_per_batch=1).awaitTermination(60)
    put([("r", "b", 1, 1.0), ("r", "b", 2, 2.0)])
    put([("r", "b", 2, 5.0), ("r", "c", 2, 3.0)])
    run()
    assert store.read("points").count() == 3
    put([("r", "d", 9, 9.0)])
    run()
    assert store.read("points").count() == 4


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    sinks.write_parquet(sinks.raw_frame(d, "r1", 0), str(tmp_path / "p"), ("run", "batch"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_table(d, str(tmp_path / "c"), ["id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    g = spark.range(4).select((F.col("id") / 2).cast("int").alias("iy"), (F.col("id") % 2).alias("ix"), F.col("id").cast("double").alias("value"))
    assert [r["value"] for r in sinks.esri_lines(g).collect()] == ["2.000000 3.000000", "0.000000 1.000000"]
