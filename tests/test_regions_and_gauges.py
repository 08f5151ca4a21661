import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_polygon
from tidemark.operators import grids, heights, joins, matchups, models
from tidemark.plans import store
from tidemark.sources import gauges, readers, regions, requests

SQUARE = {"type": "Polygon", "coordinates": [[[33, 46], [35, 46], [35, 48], [33, 48], [33, 46]]]}


def region(**more):
    return regions.from_dict({"slug": "r", "bbox": [33, 46, 35, 48]} | more)


def test_region_definitions():
    r = region(kind="river", vertical="egg2015", coord={"lon": 34, "lat": 47}, refid="7", polygon=SQUARE)
    assert regions.from_dict(r.as_dict()) == r and not r.still_water and r.datum == "EVRS_EGG2015" and r.refid == 7 and r.name == "r"
    assert r.search_box == (33, 46, 35, 48) and regions.from_dict({"slug": "x", "polygon": SQUARE}).search_box == (33, 46, 35, 48)
    for bad in ({"kind": "land"}, {"vertical": "x"}, {"bbox": None}):
        with pytest.raises(ValueError):
            region(**bad)
    assert regions.resolve({"region": {"slug": "own", "bbox": [0, 0, 1, 1]}}, {}).slug == "own" and regions.resolve({"region_slug": "r"}, {"r": r}) is r


def test_resolve_from_registry(spark):
    table = spark.createDataFrame([("reg", json.dumps({"slug": "reg", "bbox": [0, 0, 1, 1]}))], "slug string, definition string")
    assert regions.resolve({"region_slug": "reg"}, {}, table).bbox == (0, 0, 1, 1)
    with pytest.raises(KeyError, match="unknown region 'no'"):
        regions.resolve({"region_slug": "no"}, {"a": region()}, table)


def test_request_ring_and_parameters():
    ring = regions.request_ring([[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]])
    assert ring[0] == ring[-1] and [(p["lon"], p["lat"]) for p in ring[:3]] == [(0, 0), (1, 0), (1, 1)]
    holed = regions.request_ring([[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)], [(1, 1), (2, 1), (1, 2), (1, 1)]])
    assert len(holed) == 5
    circle = [(math.cos(t / 200 * math.pi), math.sin(t / 200 * math.pi)) for t in range(400)]
    assert 20 < len(regions.request_ring([[*circle, circle[0]]])) < 250
    p = requests.request_parameters(requests.product("atl03"), region(), ["g"], {"atl08_class": ["atl08_ground"]})
    assert p["cnf"] == 4 and p["resources"] == ["g"] and p["atl08_class"] == ["atl08_ground"] and len(p["poly"]) == 5
    assert requests.request_parameters(requests.product("ATL13"), region(coord={"lon": 1, "lat": 2}, refid=3), [])["atl13"] == {"coord": {"lon": 1.0, "lat": 2.0}, "refid": 3}
    for bad in (lambda: requests.request_parameters(requests.product("ATL13"), region(), []), lambda: requests.request_parameters(requests.product("ATL03"), region(), [], {"atl08_class": ["ground"]})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        requests.product("ATL99")


def test_job_errors():
    assert requests.job_errors({"product": "ATL13", "region_slug": "x"}) == []
    assert requests.job_errors({"product": "X", "batch_size": 0}) == ["unknown product X", "exactly one of region_slug and region", "batch_size outside 1 to 200"]
    bad = {"product": "ATL13", "region": {"slug": "x"}, "start": "2021", "end": "2020", "atl03": {"atl08_class": ["no"]}, "dem": {"variables": ["chm"], "resolution_m": 1}, "compare": ["x"]}
    assert len(requests.job_errors(bad)) == 7


def test_landmark_area():
    ring = regions.landmark_area([(31, 46), (33, 46), (32, 47)], buffer=0.02, west=31.5)
    assert ring[0] == ring[-1] and min(x for x, _ in ring) == 31.5 and max(y for _, y in ring) == pytest.approx(47.02, abs=1e-3)
    assert regions.landmark_area([(0, 0), (1, 0), (1, 1)], buffer=0) == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_many_edges_give_the_same_points(spark):
    circle = [(34 + math.cos(2 * math.pi * t / 300), 47 + math.sin(2 * math.pi * t / 300)) for t in range(300)]
    rings = [[*circle, circle[0]], [(33.8, 46.9), (34.2, 46.9), (34.2, 47.1), (33.8, 47.1), (33.8, 46.9)]]
    pts = spark.range(2000).select((33 + (F.col("id") % 50) * 0.041).alias("lon"), (46 + F.floor(F.col("id") / 50) * 0.051).alias("lat"))
    got = pts.select("lon", "lat", in_polygon("lon", "lat", rings).alias("in")).collect()
    import tidemark.functions.exprs as X

    few, X.FEW_EDGES = X.FEW_EDGES, 10_000
    try:
        want = pts.select("lon", "lat", in_polygon("lon", "lat", rings).alias("in")).collect()
    finally:
        X.FEW_EDGES = few
    assert got == want and 100 < sum(r["in"] for r in got) < 1900
    assert spark.range(1).select(in_polygon(F.lit(None).cast("double"), F.lit(47.0), rings).alias("x")).first()["x"] is None


def grid(spark):
    a = grids.Axis(46.0, 33.0, 0.5, 0.5, 5, 5)
    return grids.lattice(spark, a).withColumn("value", F.lit(20.0)), a


def test_heights(spark):
    pts = spark.createDataFrame([(47.0, 34.0, 30.0, 10.5, "2020-01-01"), (50.0, 34.0, 30.0, 10.5, "2023-07-01")], "lat double, lon double, h double, H_egm2008_m double, time string").withColumn("time", F.to_timestamp("time"))
    r = region(vertical="egg2015", regimes=True)
    out = heights.to_heights(pts, r, "ATL13", "h", geoid=grid(spark), last_before="2023-06-05", first_after="2023-06-19").collect()
    assert [(x["water_mask_pass"], x["H_m"], x["zeta_egg2015_m"], x["egm2008_minus_evrs_m"], x["period"]) for x in out] == [(True, 10.0, 20.0, 0.5, "PRE_BREACH"), (False, None, None, None, "POST_BREACH")]
    land = heights.to_heights(pts, region(), "ATL08", "h", undulation=grid(spark)).collect()
    assert [(x["H_m"], x["N_m"], x["vertical_datum"], x["period"]) for x in land] == [(10.0, 20.0, "EGM2008", "ALL")]
    own = heights.add_heights(pts, "h", region(), egm2008="H_egm2008_m").collect()
    assert own[0]["N_m"] == 19.5 and own[0]["H_m"] == 10.5
    with pytest.raises(ValueError, match="outside the geoid grid"):
        heights.add_heights(pts.where("lat > 49"), "h", r, geoid=grid(spark), egm2008="H_egm2008_m")
    assert heights.add_heights(pts.where("lat > 99"), "h", r, geoid=grid(spark), egm2008="H_egm2008_m").count() == 0
    with pytest.raises(ValueError):
        heights.add_heights(pts, "h", region())


def test_gauge_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ДатаЧас;Рівень\n2020-06-01 08:00;1.5\n2020-06-01 08:00;1.7\nx;2\n")
    raw = gauges.readings(gauges.read_table(spark, str(tmp_path / "a.csv")), "a")
    st = spark.createDataFrame([("a", 10.0), ("9", None)], "station_id string, zero_m double")
    r = gauges.observations(raw, st, zone="Europe/Kyiv").collect()
    assert [(x["datetime"].hour, x["stage_m"], x["WSE_baltic_m"]) for x in r] == [(5, 1.5, 11.5)]
    d = datetime.date
    for year in (2020, 2021):
        (tmp_path / "root" / "post_id=9").mkdir(parents=True, exist_ok=True)
        spark.createDataFrame([(d(year, 1, 2), 100.0, 110.0, 105.0)], "date date, h_08 double, h_20 double, h_mean double").toPandas().to_parquet(tmp_path / "root" / "post_id=9" / f"year={year}.parquet")
    out = gauges.load_observations(spark, st, root=str(tmp_path / "root"), zone="Europe/Kyiv", scale=0.01).orderBy("datetime").collect()
    assert [(x["datetime"].year, x["datetime"].hour, x["stage_m"], x["WSE_baltic_m"]) for x in out] == [(2020, 6, 1.0, None), (2020, 18, 1.1, None), (2021, 6, 1.0, None), (2021, 18, 1.1, None)]


def test_local_times(spark):
    rows = spark.createDataFrame([("2023-03-26 03:30:00",), ("2023-10-29 03:30:00",), ("2023-07-01 12:00:00",)], "t string").select(gauges.to_utc(F.to_timestamp("t"), "Europe/Kyiv").cast("string").alias("u"))
    assert [r["u"] for r in rows.collect()] == ["2023-03-26 01:00:00", None, "2023-07-01 09:00:00"]


def test_downstream(spark, tmp_path):
    book = spark.createDataFrame([("2020-01-01", "daily", "500", "0.1"), ("2020-01-02", "monthly", "1", "1")], "date string, stat_type string, water_level_cm string, water_level_m_abs string")
    years = spark.createDataFrame([("2020-01-01", 510.0, 1.0), ("2020-01-02", 520.0, 1.0), ("2020-01-03", None, 530.0)], "date string, h_mean double, h_08 double")
    for snap, v in (("version=1", 540.0), ("tmp_2", 999.0)):
        spark.createDataFrame([("2020-01-04", "level", v), ("2020-01-04", "flow", 1.0)], "date string, variable string, value double").write.parquet(str(tmp_path / snap / "daily" / "post_id=p" / "y"))
    snaps = gauges.read_versions(spark, str(tmp_path), "p")
    parts = [gauges.from_yearbook(book), gauges.from_years(years, -5.0), gauges.from_versions(snaps, -5.0)]
    out = gauges.downstream_series(parts, {"id": "p", "slug": "s"}, last_before="2020-01-02", first_after="2020-01-03").orderBy("date")
    got = [(r["date"].day, r["h_cm"], r["h_bs77_m"], r["source"], r["post_breach"]) for r in out.collect()]
    assert got == [(1, 500.0, 0.1, "yearbook_csv", False), (2, 520.0, pytest.approx(0.2), "donor_parquet", True), (4, 540.0, pytest.approx(0.4), "donor_parquet_versioned", True)]
    assert gauges.absolute_daily(out, -5.0).count() == 3
    assert gauges.from_years(years.drop("h_mean", "h_08"), None).count() == 0


def test_run_of_batches(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(str(tmp_path / "x" / "batch=0"))
    spark.createDataFrame([(3, "z")], "a int, c string").write.parquet(str(tmp_path / "x" / "batch=1"))
    assert sorted(readers.read_run(spark, str(tmp_path / "x")).columns) == ["a", "b", "batch", "c"]


def test_models_over_a_lattice(spark):
    st = spark.createDataFrame([(47.0, 34.0, 1.0), (47.2, 34.1, 2.0)], "lat double, lon double, value double")
    nodes = grids.lattice(spark, grids.Axis(47.0, 34.0, 0.1, 0.1, 3, 2))
    out = models.fit_all(st, nodes).toPandas()
    assert set(out[out["error"].notna()]["model"]) == {"plane", "linear"} and len(out) == 3 * 6 + 2
    assert out[(out["model"] == "idw_p1") & (out["iy"] == 0) & (out["ix"] == 0)]["value"].item() == pytest.approx(1.0)
    xy = models.local_plane(47.0, 34.0, np.array([46.5, 47.9]), np.array([33.1, 35.2]))
    assert np.allclose(models.from_local_plane(47.0, 34.0, xy), [(46.5, 33.1), (47.9, 35.2)], atol=1e-9)


def test_asof_with_and_without_spans(spark):
    obs = spark.range(3000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 36_000).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    probes = spark.range(2000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 61_111 - 50_000).alias("ts"), "id")
    get = lambda **o: {r["id"]: tuple(r)[3:] for r in joins.asof(probes, obs, key="key", **o).select("key", "ts", "id", "value", "interpolated", "gap_hours").collect()}
    for more in ({}, {"ends": "null", "max_gap_hours": None}, {"method": "nearest"}):
        assert get(**more) == get(span_hours=None, **more) == get(span_hours=100.0, **more)


def test_long_series_is_linear(spark):
    obs = spark.range(500_000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"))
    probes = obs.select("key", (F.col("ts") + F.expr("interval 15 seconds")).alias("ts"))
    r = joins.asof(probes, obs, key="key").agg(F.count("value"), F.sum(F.col("value") - F.unix_timestamp("ts") / 60)).first()
    assert r[0] == 500_000 and abs(r[1]) < 2


def test_small_tables(spark):
    d = spark.createDataFrame([(1, 1.5, True, None), (2, float("nan"), False, "5")], "a int, v double, ok boolean, n string")
    assert [tuple(r) for r in store.typed(d, "a bigint, v double, n int, z string").collect()] == [(1, 1.5, None, None), (2, None, 5, None)]
    r = spark.range(1).select(matchups.signed(F.lit(1.23456)).alias("s"), matchups.short_number(F.lit(2.50)).alias("n"), matchups.short_number(F.lit(3.0)).alias("m")).first()
    assert tuple(r) == ("+1.235", "2.5", "3")
    seed = spark.createDataFrame([("a",), ("b",)], "granule string")
    assert readers.seed_or_union(seed, seed, least=2).count() == 2 and readers.seed_or_union(seed, spark.createDataFrame([("c",)], "granule string"), least=3).count() == 3
