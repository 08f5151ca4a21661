import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import cop30_tile, fabdem_tile
from tidemark.sources import rasters
from tidemark.sources.tiles import TileStore, cop30_name, fabdem_name, sample_tiles_of

SIDE = 40


def height(lat, lon):
    """What the prepared tiles hold: a number for each pixel."""
    y, x = math.floor(lat), math.floor(lon)
    row, col = min(SIDE - 1, math.floor((y + 1 - lat) * SIDE)), min(SIDE - 1, math.floor((lon - x) * SIDE))
    return None if (row + col) % 11 == 0 else y * 100.0 + x + row + col / 64


@pytest.fixture
def prepared(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    (log / "tiles").mkdir(parents=True)
    monkeypatch.setenv("FETCH_LOG", str(log))
    spark.sparkContext.environment["FETCH_LOG"] = str(log)
    for y, x in ((46, 33), (46, 34), (-1, -1), (0, 0), (47, 33)):
        px = spark.range(SIDE * SIDE).select((F.col("id") / SIDE).cast("int").alias("row"), (F.col("id") % SIDE).cast("int").alias("col"))
        px = px.withColumn("value", F.when((F.col("row") + F.col("col")) % 11 != 0, F.lit(y * 100.0 + x) + F.col("row") + F.col("col") / 64))
        (name,) = rasters.write_geotiff(px, str(tmp_path / f"t{y}_{x}"), rasters.Frame(float(x), y + 1.0, 1 / SIDE, 1 / SIDE, SIDE, SIDE, 4326, -32767.0), ["value"], block=16)
        os.replace(name, log / "tiles" / f"{cop30_name(y, x)}.tif")
    return tmp_path


def test_points_get_their_pixels_and_only_their_tiles_are_fetched(spark, prepared):
    rnd = np.random.default_rng(6)
    pts = [(float(a), float(o)) for a, o in zip(rnd.uniform(46, 46.999, 300), rnd.uniform(33, 35.5, 300), strict=True)] + [(-0.5, -0.25), (-1e-9, -1e-9), (0.0, 0.0), (46.0, 33.0), (None, 3.0), (float("nan"), 1.0), (95.0, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, lat double, lon double").repartition(4)
    store = TileStore(str(prepared / "cache"), "cop30", "tests.fetchers:tile")
    have = {(46, 33), (46, 34), (-1, -1), (0, 0), (47, 33)}
    for gather in (True, False):
        got = {r["id"]: r["dem"] for r in sample_tiles_of(points, store, "dem", gather=gather).collect()}
        for i, (a, o) in enumerate(pts):
            there = a is not None and abs(a) <= 90 and (math.floor(a), math.floor(o)) in have
            assert got[i] == (height(a, o) if there else None), (a, o)
    calls = Counter((prepared / "log/calls").read_text().split())
    assert set(calls) == {cop30_name(y, x) for y, x in ((46, 33), (46, 34), (46, 35), (-1, -1), (0, 0))}  # not 47, 33
    assert sorted(os.listdir(prepared / "cache/missing")) == [cop30_name(46, 35)]
    assert not [n for n in os.listdir(prepared / "cache") if n.startswith(".")]
    sample_tiles_of(points, store, "dem").count()
    sample_tiles_of(points, store, "dem").collect()
    assert Counter((prepared / "log/calls").read_text().split()) == calls  # neither fetched nor asked for again


def test_only_blocks_with_points_are_read(spark, prepared):
    store = TileStore(str(prepared / "log/tiles"))
    name = f"{store.folder}/{cop30_name(46, 33)}.tif"
    data = bytearray(open(name, "rb").read())
    i = rasters.images(rasters._opened(name))[0]
    for b in range(9):
        if b != i.index(0, 0, 1):
            data[i.offsets[b] : i.offsets[b] + 16] = b"\xff" * 16
    open(name, "wb").write(data)
    points = spark.createDataFrame([(46.99, 33.5), (46.7, 33.45)], "lat double, lon double")
    assert [r["dem"] for r in sample_tiles_of(points, store, "dem").orderBy("lat").collect()] == [height(46.7, 33.45), height(46.99, 33.5)]
    with pytest.raises(Exception, match="decompress|zlib|Error"):
        sample_tiles_of(spark.createDataFrame([(46.01, 33.5)], "lat double, lon double"), store, "dem").collect()


def test_names_equal_the_column_functions(spark):
    at = [(0, 0), (-1, -1), (47, 34), (-33, 151), (5, -120), (89, 179), (-90, -180)]
    rows = spark.createDataFrame([(a + 0.5, o + 0.5) for a, o in at], "lat double, lon double").select(cop30_tile("lat", "lon").alias("c"), fabdem_tile("lat", "lon").alias("f")).collect()
    assert [(r["c"], r["f"]) for r in rows] == [(cop30_name(a, o), fabdem_name(a, o) + ".tif") for a, o in at]


def test_empty(spark, tmp_path):
    out = sample_tiles_of(spark.createDataFrame([], "lat double, lon double, dem0 string"), TileStore(str(tmp_path)), "dem")
    assert out.count() == 0 and out.columns == ["lat", "lon", "dem0", "dem"]
