import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_polygon
from tidemark.operators import spatial


def wavy(n, cx, cy, r, seed):
    rnd = random.Random(seed)
    at = [2 * math.pi * i / n for i in range(n)]
    p = [(cx + r * (0.7 + 0.3 * rnd.random()) * math.cos(a), cy + r * (0.7 + 0.3 * rnd.random()) * math.sin(a)) for a in at]
    return [*p, p[0]]


def coast(n, cx, cy, r, seed):
    """A ring of many short edges."""
    rnd = random.Random(seed)
    at = [2 * math.pi * i / n for i in range(n)]
    q = [r * (0.8 + 0.1 * math.sin(3 * a) + 0.05 * math.sin(41 * a) + 0.01 * math.sin(1013 * a) + rnd.uniform(-1, 1) * 2 / n) for a in at]
    p = [(cx + b * math.cos(a), cy + b * math.sin(a)) for a, b in zip(at, q, strict=True)]
    return [*p, p[0]]


def lattice_ring(seed):
    """A ring on whole numbers, that crosses itself and shares coordinates with many points."""
    rnd = random.Random(seed)
    p = [(float(rnd.randrange(10)), float(rnd.randrange(10))) for _ in range(12)]
    return [*p, p[0]]


def polygons(spark, rows):
    return spark.createDataFrame([(i, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for i, rings in rows], "id string, rings array<array<struct<lon:double,lat:double>>>")


@pytest.mark.parametrize("broadcast", [True, False])
def test_polygons_equal_the_plain_test(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", -1)
    rows = [("wave", [wavy(150, 3, 4, 3, 1), wavy(40, 3, 4, 1, 2)]), ("cross", [lattice_ring(3)]), ("cross2", [lattice_ring(4), lattice_ring(5)]), ("far", [wavy(20, 300, -40, 1, 6)]), ("box", [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]), ("line", [[(1, 1), (5, 5), (1, 1)]]), ("dot", [[(6, 6), (6, 6)]])]
    rnd = random.Random(7)
    pts = [(rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for _ in range(400)] + [(x / 2, y / 2) for x in range(-1, 22) for y in range(-1, 22)] + [p for _, rings in rows for r in rings for p in r] + [(299.9, -40.0), (None, 3.0), (float("nan"), 1.0), (1e300, 2.0)]
    points = spark.createDataFrame([(i, None if x is None else float(x), None if y is None else float(y)) for i, (x, y) in enumerate(pts)], "n long, lon double, lat double").repartition(3)
    cover = spatial.polygon_cover(spatial.edges_of(polygons(spark, rows), "id"), most=4)
    got = sorted((r["n"], r["polygon"]) for r in spatial.polygon_join(points, cover).collect())
    want = []
    for name, rings in rows:
        want += [(r["n"], name) for r in points.where(in_polygon("lon", "lat", rings)).collect()]
    assert got == sorted(want) and len(got) > 500


def test_a_ring_of_many_vertices(spark):
    ring = coast(100_000, 20.0, 50.0, 5.0, 9)
    cover = spatial.polygon_cover(spatial.edges_of(polygons(spark, [("coast", [ring])]), "id"))
    assert cover.cells.where(F.size("edges") > 400).isEmpty()
    rnd = np.random.default_rng(4)
    x, y = rnd.uniform(14, 26, 3000), rnd.uniform(44, 56, 3000)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "n long, lon double, lat double")
    got = {r["n"] for r in spatial.polygon_join(points, cover).collect()}
    a = np.array(ring)
    x1, y1, x2, y2 = a[:-1, 0], a[:-1, 1], a[1:, 0], a[1:, 1]
    want = {i for i in range(3000) if np.count_nonzero(((y1 > y[i]) != (y2 > y[i])) & (x[i] < (x2 - x1) * (y[i] - y1) / (y2 - y1) + x1)) % 2}
    assert got == want and 500 < len(got) < 2500


def test_no_polygons(spark):
    cover = spatial.polygon_cover(spatial.edges_of(polygons(spark, []), "id"))
    assert spatial.polygon_join(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), cover).columns == ["lon", "lat", "polygon"]
    assert spatial.polygon_join(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), cover).count() == 0


def stations():
    rnd = random.Random(3)
    out = [(f"a{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)]
    out += [(f"b{i}", 47 + rnd.gauss(0, 0.01), 34 + rnd.gauss(0, 0.01)) for i in range(200)]
    out += [("n", 90.0, 10.0), ("s", -90.0, 0.0), ("e", 0.0, 180.0), ("w", 0.0, -180.0), ("m", 0.0, 179.9), ("z", 47.0, 34.0), ("y", 47.0, 34.0), ("x", None, 3.0), ("v", 5.0, float("nan"))]
    out += [(f"g{i}{j}", 10.0 + i, 20.0 + j) for i in range(6) for j in range(6)]
    return out


def places():
    rnd = random.Random(8)
    out = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(500)] + [(47 + rnd.gauss(0, 0.02), 34 + rnd.gauss(0, 0.02)) for _ in range(300)]
    out += [(90.0, -77.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -179.99), (0.0, 0.0), (47.0, 34.0), (10.5, 20.0), (11.0, 21.0), (0.0, 90.0), (45.0, 45.0), (89.99, 179.0)]
    return out


def brute(lat, lon, known, k):
    a, o = math.radians(lat), math.radians(lon)
    far = []
    for name, b, p in known:
        if b is not None and p is not None and not math.isnan(b) and not math.isnan(p):
            b, p = math.radians(b), math.radians(p)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2
            far.append((2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h))), name))
    return sorted(far)[:k]


@pytest.mark.parametrize(("k", "broadcast"), [(1, True), (1, False), (4, True)])
def test_nearest_equals_brute_force(spark, k, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", -1)
    known, pts = stations(), places()
    frame = spark.createDataFrame(known, "name string, s_lat double, s_lon double").repartition(4)
    cover = spatial.station_cover(frame, k=k, order=["name"])
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(9999, None, 1.0)], "n long, lat double, lon double").repartition(3)
    rows = {r["n"]: r["near"] for r in spatial.nearest(points, cover, k=k).collect()}
    assert len(rows) == len(pts) + 1 and rows[9999] is None
    for i, (a, o) in enumerate(pts):
        want = brute(a, o, known, k)
        assert [round(r["distance_km"], 5) for r in rows[i]] == pytest.approx([round(d, 5) for d, _ in want], abs=2e-5), (i, a, o)
        clear = [n for j, (d, n) in enumerate(want) if all(abs(d - e) > 1e-6 for m, (e, _) in enumerate(brute(a, o, known, k + 1)) if m != j)]
        assert set(clear) <= {r["name"] for r in rows[i]}
    assert rows[500 + 300 + 5][0]["name"] == "y"  # two stations at one place: the first by name
    assert cover.cells.agg(F.max(F.size("near"))).first()[0] <= 40


def test_many_stations(spark):
    rnd = np.random.default_rng(5)
    n = 10_000
    lat, lon = np.degrees(np.arcsin(rnd.uniform(-1, 1, n))), rnd.uniform(-180, 180, n)
    known = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon, strict=True))], "id long, s_lat double, s_lon double")
    pts = [(float(np.degrees(np.arcsin(z))), float(o)) for z, o in zip(rnd.uniform(-1, 1, 400), rnd.uniform(-180, 180, 400), strict=True)]
    got = spatial.nearest_any(spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "n long, lat double, lon double"), known).collect()
    v = lambda a, o: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(o)), np.cos(np.radians(a)) * np.sin(np.radians(o)), np.sin(np.radians(a))], -1)
    best = np.argmax(v(np.array([p[0] for p in pts]), np.array([p[1] for p in pts])) @ v(lat, lon).T, 1)
    assert {r["n"]: r["id"] for r in got} == dict(enumerate(best.tolist()))


@pytest.mark.parametrize("k", [1, 4])
def test_cells_dealt_over_tasks(spark, k, monkeypatch):
    """Cells of more stations than one task refines are split in steps, each task pruning a share; the rest takes no step."""
    rnd = random.Random(9)
    known = [(i, 47 + rnd.randrange(4000) / 1e4, 34 + rnd.randrange(4000) / 1e4) for i in range(3000)]
    frame = spark.createDataFrame(known, "name long, s_lat double, s_lon double").repartition(4)
    cuts, plain = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: cuts.append(1) or plain(df))
    spatial.station_cover(frame, k=k, order=["name"])
    assert len(cuts) <= 4
    monkeypatch.setattr(spatial, "LOCAL", 700)
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", -1)
    cover = spatial.station_cover(frame, k=k, order=["name"])
    assert 8 < len(cuts) <= 24 and cover.cells.agg(F.max(F.size("near"))).first()[0] <= 12 + 2 * k
    pts = [(47 + rnd.uniform(-0.1, 0.5), 34 + rnd.uniform(-0.1, 0.5)) for _ in range(150)] + [(-47.0, -146.0), (90.0, 0.0), (0.0, 180.0), (10.0, -60.0)]
    got = {r["n"]: r["near"] for r in spatial.nearest(spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "n long, lat double, lon double"), cover, k=k).collect()}
    for i, (a, o) in enumerate(pts):
        assert [r["distance_km"] for r in got[i]] == pytest.approx([d for d, _ in brute(a, o, known, k)], abs=2e-5), (i, a, o)


def test_idw_ties_by_order(spark):
    """Of controls equally far the first by `order` counts, not that of the least value."""
    known = spark.createDataFrame([(2, 0.0, 1.0, 1.0), (1, 0.0, -1.0, 9.0)], "c long, s_lat double, s_lon double, v double")
    got = spatial.idw(spark.createDataFrame([(0.0, 0.0)], "lat double, lon double"), known, "v", k=1, order=["c"]).first()
    assert got["value"] == pytest.approx(9.0)


def test_no_stations(spark):
    none = spark.createDataFrame([], "name string, s_lat double, s_lon double")
    out = spatial.nearest_any(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"), none).collect()
    assert [tuple(r) for r in out] == [(1.0, 2.0, None, None, None, None)]
