"""Elevations from tiles of one degree that are fetched when points need them.

Points go where they are: a task looks up the tiles of its own points, and of each tile reads the directory and the blocks
that hold points, nothing else. A tile is in the cache folder, or known to be missing, or fetched; a fetched file appears
under its name when it is whole, so tasks that fetch one at the same time do no harm. The folder must be mounted on all
machines, as that of the raster source.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import finite
from tidemark.sources.rasters import Image, _opened, decoded, images

#: Beyond this a pixel is no height.
MOST_HEIGHT = 1e4
#: Decoded blocks and directories that a task keeps.
KEPT_BLOCKS, KEPT_HEADS = 64, 256


def cop30_name(lat: int, lon: int) -> str:
    """Name of the tile whose corner in the south-west is (lat, lon). Fixed format."""
    return f"Copernicus_DSM_COG_10_{'N' if lat >= 0 else 'S'}{abs(lat):02d}_00_{'E' if lon >= 0 else 'W'}{abs(lon):03d}_00_DEM"


def fabdem_name(lat: int, lon: int) -> str:
    """Fixed format."""
    return f"{'N' if lat >= 0 else 'S'}{abs(lat):02d}{'E' if lon >= 0 else 'W'}{abs(lon):03d}_FABDEM_V1-2"


NAMES: dict[str, Callable[[int, int], str]] = {"cop30": cop30_name, "fabdem": fabdem_name}


@dataclass(frozen=True)
class TileStore:
    """Tiles in `folder`; `fetcher` is module:function that gives a tile's bytes by name, or None where there is no such tile."""

    folder: str
    kind: str = "cop30"
    fetcher: str | None = None

    def path(self, lat: int, lon: int) -> str | None:
        """The tile's file, fetched if need be; None where there is none."""
        name = NAMES[self.kind](lat, lon)
        at, missing = f"{self.folder}/{name}.tif", f"{self.folder}/missing/{name}"
        if os.path.exists(at):
            return at
        if self.fetcher is None or os.path.exists(missing):
            return None
        module, _, function = self.fetcher.partition(":")
        data = getattr(importlib.import_module(module), function)(name)
        if data is None:
            os.makedirs(os.path.dirname(missing), exist_ok=True)
            open(missing, "wb").close()
            return None
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, at)
        return at


class _Kept(OrderedDict):
    """The last few results of a function."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def get_or(self, key, make):
        if key in self:
            self.move_to_end(key)
            return self[key]
        while len(self) >= self.most:
            self.popitem(last=False)
        self[key] = make()
        return self[key]


def sampled(store: TileStore, lat: np.ndarray, lon: np.ndarray, heads: _Kept, blocks: _Kept) -> np.ndarray:
    """The pixel that holds each point, NaN where there is none; each tile and block is opened once."""
    out = np.full(len(lat), np.nan)
    y, x = np.floor(lat).astype(int), np.floor(lon).astype(int)
    tile = y * 1000 + x
    for t in np.unique(tile):
        mine = np.flatnonzero(tile == t)
        ty, tx = int(y[mine[0]]), int(x[mine[0]])

        def head(ty=ty, tx=tx) -> tuple[str, Image] | None:
            path = store.path(ty, tx)
            return path and (path, images(_opened(path))[0])

        got = heads.get_or((ty, tx), head)
        if not got:
            continue
        path, i = got
        row = np.clip(np.floor((i.y1 - lat[mine]) / i.dy).astype(int), 0, i.height - 1)
        col = np.clip(np.floor((lon[mine] - i.x0) / i.dx).astype(int), 0, i.width - 1)
        block = (row // i.tile_height) * i.across + col // i.tile_width
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            by, bx = divmod(int(b), i.across)
            px = blocks.get_or((path, by, bx), lambda by=by, bx=bx, i=i, path=path: decoded(i, by, bx, 0, _opened(path)))
            out[mine[at]] = px[row[at] - by * i.tile_height, col[at] - bx * i.tile_width]
    out[~(np.abs(out) <= MOST_HEIGHT)] = np.nan
    return out


def sample_tiles_of(points: DataFrame, store: TileStore, out: str, *, lat="lat", lon="lon", gather: bool = True) -> DataFrame:
    """Adds `out`, the height of the pixel at each point; null without place, tile or data.

    With `gather` points are dealt by sixteenths of a degree first, in as many tasks as Spark finds right, so that each block is
    read by one or a few tasks; without it there is no shuffle, for points that lie together already."""
    rows = points.withColumns({"_y": finite(lat), "_x": finite(lon)})
    if gather:
        rows = rows.withColumns({"_ky": F.floor(F.col("_y") * 16), "_kx": F.floor(F.col("_x") * 16)}).hint("rebalance", "_ky", "_kx").drop("_ky", "_kx")
    schema = T.StructType([*points.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        heads, blocks = _Kept(KEPT_HEADS), _Kept(KEPT_BLOCKS)
        for batch in batches:
            *columns, y, x = batch.columns
            y, x = (c.to_numpy(zero_copy_only=False).astype(float) for c in (y, x))
            ok = np.flatnonzero((np.abs(y) <= 90) & (np.abs(x) <= 180))
            value = np.full(len(y), np.nan)
            value[ok] = sampled(store, y[ok], x[ok], heads, blocks)
            yield pa.record_batch([*columns, pa.array(value, mask=np.isnan(value))], names=[*batch.schema.names[:-2], out])

    return rows.mapInArrow(run, schema)


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
