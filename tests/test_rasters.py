import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import rasters
from tidemark.sources.rasters import Frame, images


def cells(spark, rows, cols, holes=True):
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(10, 3, (rows, cols)), rnd.integers(0, 9, (rows, cols)).astype(float)
    if holes:
        a[rnd.random((rows, cols)) < 0.1] = np.nan
        a[: rows // 3, : cols // 3] = np.nan
    data = [(r, c, float(a[r, c]), float(b[r, c])) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, "row int, col int, value double, n double").repartition(5), a, b


def as_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("file_blocks", [16, 2])
def test_round_trip(spark, tmp_path, file_blocks):
    df, a, b = cells(spark, 70, 90)
    frame = Frame(33.0, 48.0, 0.01, 0.02, 70, 90, 4258, -9999.0, {"AREA": "Rhône & <Saône>", "UNIT": "metre"})
    files = rasters.write_geotiff(df, str(tmp_path / "r"), frame, ["value", "n"], descriptions=["level", "n_points"], block=16, file_blocks=file_blocks)
    assert len(files) == (1 if file_blocks == 16 else 9) and sorted(os.listdir(tmp_path / "r")) == sorted(os.path.basename(f) for f in files)
    for band, want in ((1, a), (2, b)):
        px = rasters.read_geotiff(spark, str(tmp_path / "r"), band=band)
        assert np.array_equal(as_array(px, (70, 90)), want.astype(np.float32), equal_nan=True)
        assert px.where("abs(lat - (48.0 - (row + 0.5) * 0.02)) > 1e-9 or abs(lon - (33.0 + (col + 0.5) * 0.01)) > 1e-9").isEmpty()
        stored = rasters.read_stored(spark, str(tmp_path / "r"), band=band)
        assert np.array_equal(as_array(stored, (70, 90)), want.astype(np.float32), equal_nan=True)
    i = images(rasters._opened(files[0]))[0]
    assert (i.epsg, i.nodata, i.tags["AREA"], i.tags["0:DESCRIPTION"], i.bands) == (4258, -9999.0, "Rhône & <Saône>", "level", 2)
    assert 0 in i.counts  # blocks without data take no room


def test_overviews(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "OVERVIEWS_FROM", 40)
    df, a, _ = cells(spark, 45, 51)
    rasters.write_geotiff(df, str(tmp_path), Frame(0.0, 45.0, 1.0, 1.0, 45, 51, 32636, float("nan")), ["value"], block=16)
    found = images(rasters._opened(str(tmp_path / "raster.tif")))
    assert [(i.height, i.width, i.reduced) for i in found] == [(45, 51, False), (23, 26, True), (12, 13, True), (6, 7, True)]
    for level, f in ((1, 2), (2, 4), (3, 8)):
        want = np.array([[np.nanmean(x) if np.isfinite(x := a[r * f : r * f + f, c * f : c * f + f]).any() else np.nan for c in range(-(-51 // f))] for r in range(-(-45 // f))])
        got = as_array(rasters.read_geotiff(spark, str(tmp_path), level=level), want.shape)
        assert np.allclose(got, want, rtol=1e-6, equal_nan=True)


def test_only_wanted_tiles_are_opened(spark, tmp_path):
    df, a, _ = cells(spark, 64, 64, holes=False)
    (name,) = rasters.write_geotiff(df, str(tmp_path), Frame(30.0, 50.0, 0.01, 0.01, 64, 64), ["value"], block=16)
    i = images(rasters._opened(name))[0]
    data = bytearray(open(name, "rb").read())
    spoiled = i.index(0, 3, 3)  # reading this tile fails
    data[i.offsets[spoiled] : i.offsets[spoiled] + 20] = b"\xff" * 20
    open(name, "wb").write(data)
    px = rasters.read_geotiff(spark, str(tmp_path))
    assert px.where("row < 48").count() == 48 * 64
    assert px.where((F.col("lat") > 49.6) & (F.col("lon") <= 30.2)).count() == 40 * 20
    assert px.where("col in (3, 5) and row = 50").count() == 2
    assert px.where("row > 1000").count() == 0
    with pytest.raises(Exception, match="decompress|zlib|Error"):
        px.count()


def plain_tiff(path, x, *, order, strips, planar, predictor, deflate):
    """A small file in other shapes than the writer's, put together by hand."""
    import struct

    bands, h, w = x.shape
    o, kind = order, {"f": 3, "i": 2, "u": 1}[x.dtype.kind]
    x = x.astype(x.dtype.newbyteorder(o))
    rows = 5 if strips else h
    pieces = []
    for b in range(bands if planar == 2 else 1):
        for r in range(0, h, rows):
            y = x[b : b + 1, r : r + rows] if planar == 2 else x[:, r : r + rows]
            y = np.ascontiguousarray(y.transpose(1, 2, 0))
            if predictor == 2:
                y = np.concatenate([y[:, :1], y[:, 1:] - y[:, :-1]], 1).astype(y.dtype)
            pieces.append(zlib.compress(y.tobytes()) if deflate else y.tobytes())
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [x.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (277, 3, [bands]), (278, 4, [rows]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * bands), (273, 4, [0] * len(pieces)), (279, 4, [len(p) for p in pieces])]
    tags.sort()
    size = {3: 2, 4: 4}
    at = 8 + 2 + 12 * len(tags) + 4
    extra = b""
    entries, start = [], at + sum(size[k] * len(v) for _, k, v in tags if size[k] * len(v) > 4)
    offs = [start + sum(map(len, pieces[:i])) for i in range(len(pieces))]
    for t, k, v in tags:
        v = offs if t == 273 else v
        d = struct.pack(o + {3: "H", 4: "I"}[k] * len(v), *v)
        if len(d) > 4:
            entries.append(struct.pack(o + "HHII", t, k, len(v), at + len(extra)))
            extra += d
        else:
            entries.append(struct.pack(o + "HHI", t, k, len(v)) + d.ljust(4, b"\0"))
    head = (b"II" if o == "<" else b"MM") + struct.pack(o + "HI", 42, 8) + struct.pack(o + "H", len(tags))
    path.write_bytes(head + b"".join(entries) + struct.pack(o + "I", 0) + extra + b"".join(pieces))


@pytest.mark.parametrize(("order", "strips", "planar", "predictor", "deflate", "dtype"), [("<", True, 1, 1, True, "i2"), (">", True, 2, 1, False, "f4"), ("<", False, 1, 2, True, "u1"), (">", True, 1, 2, True, "i4"), ("<", True, 2, 1, True, "f8")])
def test_files_of_others(spark, tmp_path, order, strips, planar, predictor, deflate, dtype):
    x = np.random.default_rng(3).integers(0, 100, (2, 13, 7)).astype(dtype)
    plain_tiff(tmp_path / "a.tif", x, order=order, strips=strips, planar=planar, predictor=predictor, deflate=deflate)
    for band in (1, 2):
        assert np.array_equal(as_array(rasters.read_geotiff(spark, str(tmp_path / "a.tif"), band=band), (13, 7)), x[band - 1])


def test_what_does_not_go(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"not a raster at all")
    with pytest.raises(Exception, match="not a TIFF"):
        rasters.read_geotiff(spark, str(tmp_path / "a.tif")).count()
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "row int, col int, value double")
    with pytest.raises(Exception, match="one pixel"):
        rasters.write_geotiff(twice, str(tmp_path / "b"), Frame(0, 1, 1, 1, 1, 1), ["value"])


def test_sampling_a_raster_is_sampling_its_grid(spark, tmp_path):
    from tidemark.operators import grids

    axis = grids.Axis(47.0, 33.0, 0.1, 0.2, 12, 15)
    grid = grids.lattice(spark, axis).withColumn("value", F.col("iy") * 2.0 + F.col("ix"))
    px = grid.select((F.lit(axis.ny - 1) - F.col("iy")).alias("row"), F.col("ix").alias("col"), "value")
    rasters.write_geotiff(px, str(tmp_path), Frame.of_nodes(47.0, 33.0, 0.1, 0.2, 12, 15), ["value"], block=16)
    back = rasters.grid_of(rasters.read_geotiff(spark, str(tmp_path), band=1))
    points = spark.createDataFrame([(47.05 + 0.013 * i, 33.1 + 0.02 * i) for i in range(40)] + [(47.0, 33.0), (40.0, 33.0)], "lat double, lon double")
    want, got = (grids.sample_bilinear(points, g, axis, "z").orderBy("lat", "lon").collect() for g in (grid, back))
    assert [r["z"] for r in got] == pytest.approx([r["z"] for r in want], abs=1e-4) and sum(r["z"] is None for r in got) == 1
