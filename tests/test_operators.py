import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import grids, joins, matchups, models, robust
from tidemark.plans import store


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_robust_vectors(spark):
    rows = [("a", v) for v in (10.0, 10.0, 10.0, 10.0, 20.0)] + [("b", float(v)) for v in range(1, 6)] + [("b", float("nan")), ("b", None), (None, 1.0), ("c", None)]
    got = {r["k"]: r for r in robust.robust_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["a"]["mad"] == 0 and got["b"]["mad"] == 1 and got["b"]["nmad"] == 1.4826 and got["b"]["n_points"] == 5
    assert None in got and "c" not in got
    assert abs(got["b"]["p05"] - np.percentile([1, 2, 3, 4, 5], 5)) < 1e-12


def flat_pass(spark, n=60, span=0.15, level=16.0):
    rng = np.random.default_rng(0)
    rows = [(f"2022-05-01T00:00:{i % 60:02d}", 545, "gt2r", 47.0 + span * i / n, 34.0, level + float(rng.normal(0, 0.02)), 0.03, "PRE", True) for i in range(n)]
    d = spark.createDataFrame(rows, "t string, rgt int, beam string, lat double, lon double, height_m double, stdev double, period string, on_water boolean")
    return d.select("*", F.to_timestamp("t").alias("time"), F.to_date("t").alias("date"))


def test_pass_levels(spark):
    r = robust.pass_levels(flat_pass(spark)).collect()
    assert len(r) == 1 and r[0]["n_points"] == 60 and r[0]["qc_pass"] and abs(r[0]["median"] - 16) < 0.02
    r = robust.named_transect(robust.pass_levels(flat_pass(spark, 30, 0.001))).first()
    assert "track_too_short" in r["qc_flags"].split("|") and r["transect"] == "545_gt2r"


def test_slope(spark):
    lat = [47 + 0.2 * i / 49 for i in range(50)]
    rows = [("x", a, 34.0, 10 + 0.5 * math.radians(a - 47) * X.EARTH_KM) for a in reversed(lat)] + [("two", 47.0, 34.0, 1.0), ("two", 47.1, 34.0, 2.0), ("same", 47.0, 34.0, 1.0), ("same", 47.0, 34.0, 1.0), ("same", 47.0, 34.0, 3.0)]
    got = {r["k"]: r for r in robust.track_slope(spark.createDataFrame(rows, "k string, lat double, lon double, h double"), ["k"], "lat", "lon", "h").collect()}
    assert abs(got["x"]["slope_m_per_km"] - 0.5) < 1e-6
    assert got["two"]["slope_m_per_km"] is None and got["two"]["length_km"] > 10
    assert got["same"]["slope_m_per_km"] is None and got["same"]["length_km"] == 0


def test_asof(spark):
    obs = spark.createDataFrame([("s", "2020-01-01 00:00:00", 1.0), ("s", "2020-01-01 12:00:00", 1.2), ("s", "2020-01-02 00:00:00", 1.4), ("one", "2020-01-01 00:00:00", 5.0), ("s", "2020-01-03 00:00:00", float("nan"))], "station_id string, t string, v double").withColumn("ts", F.to_timestamp("t"))
    asks = [("s", "2020-01-01 18:00:00"), ("s", "2020-01-01 13:00:00"), ("s", "2020-01-10 00:00:00"), ("u", "2020-01-01 00:00:00"), ("s", "2020-01-01 12:00:00"), ("s", "2019-12-31 20:00:00"), ("one", "2020-01-01 01:00:00"), ("s", "2020-01-01 06:00:00")]
    probes = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "i int, station_id string, t string").withColumn("ts", F.to_timestamp("t"))
    lin = {r["i"]: (r["value"], r["interpolated"], r["gap_hours"]) for r in joins.asof(probes, obs, key="station_id", value="v", max_gap_hours=12).collect()}
    assert lin[0][0] == pytest.approx(1.3) and lin[0][1:] == (True, 6.0)
    assert lin[2] == (None, False, 192.0) and lin[3] == (None, False, None)
    assert lin[4] == (1.2, True, 0.0) and lin[5] == (1.0, False, 4.0) and lin[6] == (5.0, False, 1.0)
    near = {r["i"]: r["value"] for r in joins.asof(probes, obs, key="station_id", value="v", method="nearest", max_gap_hours=12).collect()}
    assert near[1] == 1.2 and near[7] == 1.0, "a tie goes to the earlier"
    none = {r["i"]: r["value"] for r in joins.asof(probes, obs, key="station_id", value="v", max_gap_hours=None, ends="null").collect()}
    assert none[2] is None and none[5] is None and none[4] == 1.2


@pytest.mark.parametrize("method, ends, gap", [("linear", "nearest", 30.0), ("nearest", "nearest", None), ("linear", "null", None)])
def test_asof_by_spans(spark, method, ends, gap):
    rng = np.random.default_rng(3)
    at = lambda n: [(str(rng.choice(["a", "b", "c"])), int(x)) for x in rng.integers(0, 40 * 86400, n)]
    obs = spark.createDataFrame([(k, t, float(t % 97)) for k, t in at(120)], "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    probes = spark.createDataFrame([(i, *x) for i, x in enumerate(at(200) + [("none", 5)])], "i int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    run = lambda span: sorted(map(tuple, joins.asof(probes, obs, key="k", value="v", method=method, ends=ends, max_gap_hours=gap, span_hours=span).select("i", "value", "interpolated", "gap_hours").collect()))
    assert run(None) == run(36.0) == run(24.0 * 365)


def test_radius_join_by_cells(spark, monkeypatch):
    p = spark.createDataFrame([(i, 47 + i * 0.013, 34 + i * 0.021) for i in range(100)], "id int, lat double, lon double")
    s = spark.createDataFrame([(i, 47 + i * 0.1, 34 + i * 0.2) for i in range(12)], "s int, s_lat double, s_lon double")
    few = sorted(map(tuple, joins.radius_join(p, s, 9.0).select("id", "s").collect()))
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    assert sorted(map(tuple, joins.radius_join(p, s, 9.0).select("id", "s").collect())) == few and few


def test_nearest_station_tie(spark):
    p = spark.createDataFrame([(47.5, 34.0), (47.9, 34.0)], "lat double, lon double")
    got = [r["station"] for r in joins.nearest_station(p, [("a", 48.0, 34.0, 1.0, 0.1), ("b", 47.0, 34.0, 2.0, None), ("c", 47.5, 34.0, None, None)]).collect()]
    assert got[1] == "a" and got[0] in ("a", "b")


def test_grid(spark):
    a = grids.Axis(46.0, 33.0, 0.5, 0.25, 5, 7)
    g = grids.lattice(spark, a).withColumn("value", 10 + 2 * F.col("lat") + 3 * F.col("lon"))
    p = spark.createDataFrame([(46.3, 33.1), (48.0, 34.5), (46.0, 33.0), (45.9, 33.1), (47.2, 34.6)], "lat double, lon double")
    got = [r["z"] for r in grids.sample_bilinear(p, g, a, "z").orderBy("lat").collect()]
    assert got[0] is None and got[1] == pytest.approx(10 + 92 + 99) and got[2] == pytest.approx(10 + 2 * 46.3 + 3 * 33.1) and got[3] is None and got[4] == pytest.approx(10 + 96 + 103.5)
    assert grids.axis_of(g) == a
    hole = g.withColumn("value", F.when((F.col("iy") > 0) & (F.col("ix") < 6), F.col("value")))
    assert grids.trim_to_valid(hole).count() == 4 * 6
    assert grids.validated(g, {"mean": g.agg(F.avg("value")).first()[0]}).first()["ok"]
    with pytest.raises(ValueError):
        grids.clip_to_box(g, 0, 0, 1, 1)


def test_gridding(spark):
    p = spark.createDataFrame([(34.5, 47.5, 10.0), (34.5001, 47.5001, 12.0), (34.52, 47.52, 20.0), (34.6, 47.6, None)], "lon double, lat double, h double")
    cells = grids.grid_points(p, "h", 100.0)
    assert {r["value"] for r in cells.collect()} == {11.0, 20.0} and grids.raster_stats(cells).first()["points"] == 3
    assert cells.first()["epsg"] == 32636
    ring = grids.footprint(cells, 100.0).first()["ring"]
    assert len(ring) == 5 and ring[0] == ring[4] and X.ring_area([(p["lon"], p["lat"]) for p in ring]) > 0
    assert min(p["lon"] for p in ring) <= 34.5 <= max(p["lon"] for p in ring)


def test_utm_round_trip(spark):
    for lat, lon, epsg in ((47.5, 34.5, 32636), (-33.9, 18.4, 32734), (0.0, 3.0, 32631), (60.0, 5.0, 32632)):
        x, y = X.utm_forward(F.lit(lat), F.lit(lon), F.lit(epsg))
        r = one(spark, x=x, y=y)
        a, o = X.utm_inverse(F.lit(r["x"]), F.lit(r["y"]), F.lit(epsg))
        b = one(spark, a=a, o=o)
        assert abs(b["a"] - lat) < 1e-9 and abs(b["o"] - lon) < 1e-9
    x, y = X.utm_forward(F.lit(0.0), F.lit(3.0), F.lit(32631))
    assert one(spark, x=x, y=y)["x"] == pytest.approx(500000.0)


def test_small_functions(spark):
    r = one(
        spark, a=X.angle(F.lit("-12°30'36\"")), b=X.angle(F.lit("7.5")), c=X.angle(F.lit("x")), m=X.masked(F.lit(3.4e38)), n=X.masked(F.lit("4.5")), g=X.beam_label(F.lit(20)), h=X.beam_label(F.lit(7)),
        z=X.fabdem_zip(F.lit(-3.2), F.lit(-71.0)), t=X.fabdem_tile(F.lit(47.2), F.lit(33.9)), k=X.cop30_tile(F.lit(-0.5), F.lit(179.9)),
        f=X.local_flags(F.lit(3), F.lit(None).cast("double"), F.lit(-4.0)), q=X.reservoir_flags(F.lit(30), F.lit(0.1), F.lit(0.2), F.lit(None).cast("double"), F.lit(0.1), F.lit(0.2)),
        i=X.in_polygon(F.lit(0.5), F.lit(0.5), [X.box_ring(0, 0, 1, 1)]), j=X.in_polygon(F.lit(1.0), F.lit(0.5), [X.box_ring(0, 0, 1, 1)]),
    )
    assert r["a"] == pytest.approx(-12.51) and r["b"] == 7.5 and r["c"] is None and r["m"] is None and r["n"] == 4.5
    assert (r["g"], r["h"], r["z"], r["t"]) == ("gt1r", "7", "S10W080-N00W070_FABDEM_V1-2.zip", "N47E033_FABDEM_V1-2.tif")
    assert r["k"] == "Copernicus_DSM_COG_10_S01_00_E179_00_DEM" and r["f"] == "too_few_points|nmad|implausible_level" and r["q"] == "slope"
    assert r["i"] and not r["j"]


def test_ladder_and_correctors(spark):
    st = spark.createDataFrame([("s", 47.771208, 35.14889, 12.0, 0.1)], "station_id string, s_lat double, s_lon double, zero_m double, delta_m double")
    rng = np.random.default_rng(0)
    rows, obs = [], []
    for p, (km, stage) in enumerate([(0.3, 3.0), (0.8, 3.2), (1.5, 2.9), (2.5, 3.1), (4.0, 3.3), (0.4, 9.0)]):
        level = 12.34 + stage if km != 0.4 else 5.0
        rows += [(f"2022-05-{p + 1:02d} 12:00:00", 500 + p, "gt1l", 47.771208 + km / 111.195, 35.14889, float(level + rng.normal(0, 0.01)), "PRE", True) for _ in range(30)]
        obs += [("s", f"2022-05-{p + 1:02d} {h}:00:00", stage) for h in ("06", "18")]
    pts = spark.createDataFrame(rows, "t string, rgt int, beam string, lat double, lon double, height_m double, period string, on_water boolean").withColumns({"time": F.to_timestamp("t"), "date": F.to_date("t")})
    gauge = spark.createDataFrame(obs, "station_id string, t string, stage_m double").withColumn("datetime", F.to_timestamp("t"))
    level = spark.createDataFrame([(f"2022-05-{p + 1:02d}", 15.3) for p in range(6)], "d string, reservoir_level double").select(F.to_date("d").alias("date"), "reservoir_level")
    passes = matchups.local_passes(pts, st, [0.1, 0.5, 2.0, 5.0], level)
    assert passes.where("qc_flags = 'implausible_level'").count() == 3
    found = matchups.local_matchups(passes, gauge, st)
    ladder = {r["radius_km"]: r for r in matchups.radius_ladder(found, st, [0.1, 0.5, 2.0, 5.0]).collect()}
    assert [ladder[r]["n"] for r in (0.1, 0.5, 2.0, 5.0)] == [0, 1, 3, 5] and abs(ladder[5.0]["median"] - 12.34) < 0.02
    assert ladder[2.0]["indicative"] and not ladder[5.0]["indicative"] and ladder[0.1]["median"] is None
    rep = matchups.reported_radius(matchups.radius_ladder(found, st, [0.1, 0.5, 2.0, 5.0]))
    assert rep.first()["reported_radius_km"] == 5.0
    assert matchups.station_summary(matchups.radius_ladder(found, st, [2.0, 5.0])).first()["note"].startswith("fewer")
    c = matchups.correctors(passes, gauge, gauge, st)
    row = matchups.corrector_stations(c, rep).first()
    assert row["c_a"] == pytest.approx(12.0 + 0.1 - 12.34, abs=0.02) and row["flag"] == "OK" and row["temporal_spread"] < 0.02
    assert {r["rgt"] for r in matchups.per_track(found, 5.0).collect()} >= {"ALL", "500"}


def test_models(spark):
    rng = np.random.default_rng(1)
    xy, at = rng.uniform(0, 1e4, (7, 2)), rng.uniform(2e3, 8e3, (5, 2))
    v = 3 + 0.001 * xy[:, 0] - 0.002 * xy[:, 1]
    want = 3 + 0.001 * at[:, 0] - 0.002 * at[:, 1]
    assert np.allclose(models.predict("plane", xy, v, at), want)
    lin = models.predict("linear", xy, v, at)
    assert np.allclose(lin[~np.isnan(lin)], want[~np.isnan(lin)]) and np.isnan(models.predict("linear", xy, v, np.array([[1e6, 1e6]])))[0]
    assert np.allclose(models.predict("idw_p2", xy, v, xy), v)
    d, _ = models.geodesic(50.06632, -5.714748, 58.644, -3.070089)
    assert abs(d - 969954.1) < 5.0
    st = spark.createDataFrame([(f"s{i}", 47 + i * 0.1, 34 + (i % 3) * 0.2, 0.1 * i) for i in range(6)], "slug string, lat double, lon double, value double")
    folds = models.leave_one_out(st).collect()
    assert len(folds) == 30 and all(r["n_train"] == 5 for r in folds)
    ci = models.bootstrap_median(spark.createDataFrame([("a", i, float(i)) for i in range(30)] + [("b", 0, 1.0)], "k string, o int, v double"), ["k"], "v", ["o"], n=2000).collect()
    by = {r["k"]: r for r in ci}
    assert by["a"]["ci_low"] < 14.5 < by["a"]["ci_high"] and by["b"]["ci_low"] is None


def test_jobs_and_lines(spark):
    log = spark.createDataFrame([("j", 1, 1, "queued", None, {"a": "1"}), ("j", 2, 2, "running", "fetch", {"b": "2"}), ("j", 3, 3, "running", None, {"a": "3"}), ("j", 4, 4, "done", "load", None)], "job_id string, at int, seq int, status string, stage string, stats map<string,string>")
    r = store.latest_jobs(log).first()
    assert (r["status"], r["stage"], r["started_at"], r["finished_at"]) == ("done", "load", 2, 4) and r["stats"] == {"a": "3", "b": "2"}
    pts = spark.createDataFrame([("p", 2, 1.0, 2.0), ("p", 1, 0.0, 0.0), ("q", 1, 5.0, 5.0)], "k string, time int, lon double, lat double")
    lines = store.lines_of_passes(pts, ["k"]).collect()
    assert len(lines) == 1 and lines[0]["wkt"] == "LINESTRING(0.0 0.0, 1.0 2.0)"


def test_radius_join_paths_agree_at_meridian_and_pole(spark, monkeypatch):
    from tidemark.operators import joins

    points = spark.createDataFrame([(1, 10.0, -179.9), (2, 10.0, 179.95), (3, 89.9, -170.0), (4, -89.95, 100.0), (5, 10.0, 180.0), (6, 89.9999, -170.0)], "p int, lat double, lon double")
    stations = spark.createDataFrame([(1, 10.0, 179.9), (2, 89.9, 175.0), (3, -89.95, -120.0), (4, 89.95, 20.0), (5, 89.9999, 20.0)], "s int, s_lat double, s_lon double")
    rows = lambda: [sorted((r["p"], r["s"]) for r in joins.radius_join(points, stations, km).collect()) for km in (30.0, 0.1)]
    few = rows()
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    assert rows() == few and {(1, 1), (2, 1), (5, 1), (3, 2), (4, 3), (3, 4)} <= set(few[0]) and (6, 5) in few[1]


def test_mean_at_the_threshold(spark, tmp_path):
    """A mean tax of 0.04 exactly is not above it, though sums of doubles round to more."""
    from tidemark.plans.catalog import QUERIES

    groups = [[5, 5, 5, 1], [6, 3, 5, 4, 5, 1], [7, 4, 4, 3, 1, 1, 4, 8], [0, 6, 7, 0, 3, 7, 7, 4, 2], [5, 5, 5, 2]]
    rows = [(i, "A", t / 100, 1.0) for i, g in enumerate(groups) for t in g]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_tax double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["flag"]: r["n"] for r in QUERIES["qc_flag_explode"](spark, str(tmp_path)).collect()} == {"few": 5, "tax": 1}


def test_means_of_odd_taxes(spark, tmp_path):
    """A mean just above 0.04 counts, and as in SQL NaN and infinity are above it; a group without a tax is not."""
    from tidemark.plans.catalog import QUERIES

    nan, inf = float("nan"), float("inf")
    groups = [[0.04, 0.040000000001], [0.04, 0.039999999999], [0.01, nan], [0.01, inf], [0.01, -inf], [1e30, 0.01], [None, None], [None, 0.05], [inf, -inf]]
    rows = [(i, "A", t, 1.0) for i, g in enumerate(groups) for t in g]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_tax double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["flag"]: r["n"] for r in QUERIES["qc_flag_explode"](spark, str(tmp_path)).collect()} == {"few": 9, "tax": 6}
