"""GeoTIFF files as tables of pixels: a Spark data source that opens only the tiles that a query needs, and a writer of
tiled DEFLATE files with overviews.

A raster is a table with a row for each pixel (row from the north, col from the west, lat and lon of the pixel's centre).
Reading deals the tiles of all files over tasks; ranges of row, col, lat and lon in a filter reach the source, which then
leaves out tiles and whole files. Writing encodes blocks in tasks and puts them together in files of bounded size, one
file where the raster fits. Files are opened by path, so the folder must be mounted on all machines; read_stored() reads
whole files through Spark from any store.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PIXELS = "file string, row int, col int, lat double, lon double, band int, value double"

# Tags and types of the TIFF and GeoTIFF formats.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT = 284, 317, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}

#: Pixels along a side of a block that is written, blocks along a side of a file, and the factors of overviews.
BLOCK, FILE_BLOCKS, OVERVIEWS = 256, 16, (2, 4, 8)
#: Rasters get overviews from so many pixels along the shorter side on.
OVERVIEWS_FROM = 512
#: Tiles that one task reads.
TILES_A_TASK = 16


class RasterError(ValueError):
    pass


@dataclass(frozen=True)
class Image:
    """One image of a file: the raster itself or one of its overviews."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planar: int
    nodata: float | None
    x0: float
    y1: float
    dx: float
    dy: float
    epsg: int | None
    tags: dict[str, str]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    reduced: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def index(self, band: int, ty: int, tx: int) -> int:
        """Place of a tile in the file's lists; bands are counted from 0."""
        return (band * self.down * self.across if self.planar == 2 else 0) + ty * self.across + tx


def _tags(read: Callable[[int, int], bytes], at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """The entries of a directory, and where the next one is."""
    (n,) = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))
    at += 8 if big else 2
    size, room = (20, 8) if big else (12, 4)
    whole, out = read(at, n * size + 8), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), whole, i * size)
        if kind not in TYPES:
            continue
        form = f"{order}{count}s" if kind == 2 else order + TYPES[kind] * count
        length = struct.calcsize(form)
        place = i * size + size - room
        data = whole[place : place + length] if length <= room else read(struct.unpack_from(order + ("Q" if big else "I"), whole, place)[0], length)
        out[tag] = struct.unpack(form, data)
    (after,) = struct.unpack_from(order + ("Q" if big else "I"), whole, n * size)
    return out, after


def _metadata(text: str) -> dict[str, str]:
    import xml.etree.ElementTree as ET

    try:
        return {(f"{i.get('name')}" if i.get("sample") is None else f"{i.get('sample')}:{i.get('name')}"): i.text or "" for i in ET.fromstring(text)}
    except ET.ParseError:
        return {}


def images(read: Callable[[int, int], bytes]) -> list[Image]:
    """The images of a file, of which read(offset, length) gives bytes; only its directories are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] not in (42, 43):
        raise RasterError("not a TIFF file")
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    out: list[Image] = []
    while at:
        t, at = _tags(read, at, order, big)
        one = lambda tag, default=None: t.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits = set(t.get(BITS, (1,)))
        if len(bits) > 1 or (kind := KINDS.get(one(FORMAT, 1))) is None or min(bits) % 8:
            raise RasterError(f"samples of {sorted(bits)} bits, format {one(FORMAT, 1)}")
        text = lambda tag: t[tag][0].split(b"\0")[0].decode("utf-8", "replace").strip() if tag in t else None  # noqa: B023, E731
        scale, tie = t.get(PIXEL_SCALE), t.get(TIE_POINT)
        first = out[0] if out else None
        if scale and tie:
            dx, dy = scale[0], scale[1]
            x0, y1 = tie[3] - tie[0] * dx, tie[4] + tie[1] * dy
        elif first:  # an overview covers the same ground
            dx, dy, x0, y1 = first.dx * first.width / width, first.dy * first.height / height, first.x0, first.y1
        else:
            dx, dy, x0, y1 = 1.0, 1.0, 0.0, float(height)
        keys = t.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        nodata = text(NODATA)
        out.append(Image(
            width, height, one(TILE_WIDTH, width), one(TILE_HEIGHT, min(height, one(STRIP_ROWS, height))), samples, f"{order}{kind}{min(bits) // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1),
            None if nodata is None else float(nodata), x0, y1, dx, dy, codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY) or (first.epsg if first else None), _metadata(text(METADATA) or ""),
            t.get(TILE_OFFSETS) or t.get(STRIP_OFFSETS), t.get(TILE_COUNTS) or t.get(STRIP_COUNTS), bool(one(SUBFILE, 0) & 1),
        ))
    return out


def decoded(image: Image, ty: int, tx: int, band: int, read: Callable[[int, int], bytes]) -> np.ndarray:
    """The pixels of a tile, as doubles, clipped to the image; what has no data is NaN."""
    rows, cols = min(image.tile_height, image.height - ty * image.tile_height), min(image.tile_width, image.width - tx * image.tile_width)
    i = image.index(band, ty, tx)
    if not image.counts[i]:  # a tile that was left out
        return np.full((rows, cols), np.nan)
    data = read(image.offsets[i], image.counts[i])
    if image.compression in (8, 32946):
        data = zlib.decompress(data)
    elif image.compression != 1:
        raise RasterError(f"compression {image.compression}; DEFLATE and none are read")
    per, dtype = (1 if image.planar == 2 else image.bands), np.dtype(image.dtype)
    height = image.tile_height if len(data) >= image.tile_height * image.tile_width * per * dtype.itemsize else rows  # the last strip may be shorter
    if image.predictor == 3:
        raw = np.frombuffer(data, np.uint8).reshape(height, image.tile_width * dtype.itemsize, per) if per > 1 else np.frombuffer(data, np.uint8).reshape(height, -1, 1)
        planes = np.cumsum(raw, 1, dtype=np.uint8).reshape(height, dtype.itemsize, image.tile_width * per)
        x = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(height, image.tile_width, per)
    else:
        x = np.frombuffer(data, dtype, height * image.tile_width * per).reshape(height, image.tile_width, per)
        if image.predictor == 2:
            x = np.cumsum(x, 1, dtype=dtype)
    out = x[:rows, :cols, 0 if image.planar == 2 else band].astype(np.float64)
    if image.nodata is not None and not np.isnan(image.nodata):
        out[out == image.nodata] = np.nan
    return out


def encoded(values: np.ndarray, nodata: float) -> bytes:
    """A block of 32-bit floats, by byte planes and differences (predictor 3), deflated; empty where nothing has data."""
    if np.isnan(values).all():
        return b""
    x = np.where(np.isnan(values), nodata, values).astype(">f4")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, 4).transpose(0, 2, 1)).reshape(x.shape[0], -1)
    planes[:, 1:] -= planes[:, :-1].copy()
    return zlib.compress(planes.tobytes(), 6)


@dataclass(frozen=True)
class Frame:
    """Where a raster lies: the outer corner in the north-west, the size of a pixel, how many there are, the system."""

    x0: float
    y1: float
    dx: float
    dy: float
    rows: int
    cols: int
    epsg: int = 4326
    nodata: float = -9999.0
    tags: dict = field(default_factory=dict)

    @staticmethod
    def of_nodes(lat0: float, lon0: float, dlat: float, dlon: float, ny: int, nx: int, **more) -> Frame:
        """The frame of a grid table, whose nodes are the pixels' centres: iy counts from the south, so row = ny - 1 - iy."""
        return Frame(lon0 - dlon / 2, lat0 + (ny - 0.5) * dlat, dlon, dlat, ny, nx, **more)


def _directory(entries: list[tuple], at: int, last: bool, base: int) -> bytes:
    """A directory of (tag, type, values) that begins at `base`, with what does not fit into its entries behind it."""
    body, extra = [], b""
    behind = base + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        data = values if kind == 2 else struct.pack("<" + TYPES[kind] * len(values), *values)
        if len(data) <= 4:
            place = data.ljust(4, b"\0")
        else:
            place, extra = struct.pack("<I", behind + len(extra)), extra + data + b"\0" * (len(data) % 2)
        body.append(struct.pack("<HHI", tag, kind, len(values)) + place)
    return struct.pack("<H", len(entries)) + b"".join(body) + struct.pack("<I", 0 if last else at) + extra


def assembled(levels: list[tuple[Frame, dict[tuple[int, int, int], bytes]]], bands: int, block: int) -> bytes:
    """A file of a raster and its overviews: directories first, then the overviews' blocks, then the raster's own."""
    tags = levels[0][0].tags
    xml = "<GDALMetadata>" + "".join("<Item " + (f"name={quoteattr(k.split(':', 1)[1])} sample={quoteattr(k.split(':', 1)[0])}" + (' role="description"' if k.endswith(":DESCRIPTION") else "") if k.split(":", 1)[0].isdigit() and ":" in k else f"name={quoteattr(k)}") + f">{escape(str(v))}</Item>" for k, v in tags.items()) + "</GDALMetadata>\0"

    def entries(n: int, frame: Frame, offsets, counts):
        out = [(SUBFILE, 4, [1 if n else 0]), (WIDTH, 4, [frame.cols]), (HEIGHT, 4, [frame.rows]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [2]), (PREDICTOR, 3, [3]), (TILE_WIDTH, 4, [block]), (TILE_HEIGHT, 4, [block]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts), (FORMAT, 3, [3] * bands), (NODATA, 2, f"{frame.nodata:.17g}\0".encode())]
        if bands > 1:
            out.append((EXTRA, 3, [0] * (bands - 1)))
        if not n:
            geographic = 4000 <= frame.epsg < 5000
            keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, frame.epsg]
            out += [(PIXEL_SCALE, 12, [frame.dx, frame.dy, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, frame.x0, frame.y1, 0.0]), (GEO_KEYS, 3, keys), (METADATA, 2, xml.encode())]
        return out

    places = []
    for frame, blobs in levels:
        down, across = -(-frame.rows // block), -(-frame.cols // block)
        places.append([blobs.get((b, y, x), b"") for b in range(bands) for y in range(down) for x in range(across)])
    sizes = [len(_directory(entries(n, f, [0] * len(p), [0] * len(p)), 0, True, 0)) for n, ((f, _), p) in enumerate(zip(levels, places, strict=True))]
    at, offsets = 8 + sum(sizes), [[0] * len(p) for p in places]
    for n in reversed(range(len(levels))):
        for i, blob in enumerate(places[n]):
            offsets[n][i] = at if blob else 0
            at += len(blob)
    if at >= 1 << 32:
        raise RasterError("a file of 4 GB; take fewer blocks a file")
    out, base = [struct.pack("<2sHI", b"II", 42, 8)], 8
    for n, (frame, _) in enumerate(levels):
        out.append(_directory(entries(n, frame, offsets[n], [len(b) for b in places[n]]), base + sizes[n], n == len(levels) - 1, base))
        base += sizes[n]
    return b"".join([*out, *(b for n in reversed(range(len(levels))) for b in places[n])])


def _blocks(schema_bands: int, block: int, nodata: float):
    """Encoded blocks from packed pixels."""

    def run(batches):
        for batch in batches:
            *keys, pixels = batch.columns
            blobs = []
            for p in pixels:
                x = np.full((block, block), np.nan)
                at = p.values.field(0).to_numpy(zero_copy_only=False)
                x.ravel()[at] = p.values.field(1).to_numpy(zero_copy_only=False)
                blobs.append(encoded(x, nodata))
            yield pa.record_batch([*keys, pa.array(blobs, pa.binary())], names=["fy", "fx", "level", "band", "by", "bx", "blob"])

    return run


def pyramid(cells: DataFrame, values: list[str], factors=OVERVIEWS) -> DataFrame:
    """The cells as level 0, and for each factor the mean of the valid cells of each square, from sums and counts of the level before."""
    now = cells.select("row", "col", *(F.struct(F.coalesce(F.when(~F.isnan(v), F.col(v).cast("double")), F.lit(0.0)).alias("s"), F.when(F.col(v).isNotNull() & ~F.isnan(v), 1).otherwise(0).cast("long").alias("n")).alias(v) for v in values))
    mean = lambda df, level: df.select(F.lit(level).alias("level"), "row", "col", *(F.when(F.col(f"{v}.n") > 0, F.col(f"{v}.s") / F.col(f"{v}.n")).alias(v) for v in values))
    out, last = mean(now, 0), 1
    for level, factor in enumerate(factors, 1):
        step, last = factor // last, factor
        now = now.groupBy(F.floor(F.col("row") / step).cast("int").alias("row"), F.floor(F.col("col") / step).cast("int").alias("col")).agg(*(F.struct(F.sum(f"{v}.s").alias("s"), F.sum(f"{v}.n").alias("n")).alias(v) for v in values))
        out = out.unionByName(mean(now, level))
    return out


def write_geotiff(cells: DataFrame, path: str, frame: Frame, values: list[str], *, descriptions: list[str] | None = None, overviews: bool = True, block: int = BLOCK, file_blocks: int = FILE_BLOCKS) -> list[str]:
    """Writes `cells` (row from the north, col from the west, a column for each band) as files below `path`; their names.

    Null, NaN and absent pixels have no data. A raster of up to file_blocks * block pixels a side is one file, a larger
    one a file for each such square. Overviews of 2, 4 and 8 are added from OVERVIEWS_FROM pixels a side on. A file
    appears under its name when it is whole, so a repeated task does no harm. Raises if two cells are one pixel."""
    side, bands = block * file_blocks, len(values)
    factors = OVERVIEWS if overviews and min(frame.rows, frame.cols) >= OVERVIEWS_FROM else ()
    inside = cells.where(F.col("row").between(0, frame.rows - 1) & F.col("col").between(0, frame.cols - 1))
    px = pyramid(inside, values, factors)
    scale = F.element_at(F.lit([1, *factors]), F.col("level") + 1)
    per_file = (F.lit(side) / scale).cast("int")
    fy, fx = F.floor(F.col("row") / per_file).cast("int"), F.floor(F.col("col") / per_file).cast("int")
    px = px.withColumns({"fy": fy, "fx": fx}).withColumns({"r": F.col("row") - F.col("fy") * per_file, "c": F.col("col") - F.col("fx") * per_file})
    px = px.select("fy", "fx", "level", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(v).alias("v")) for i, v in enumerate(values)))).alias("b"), "r", "c")
    px = px.select("fy", "fx", "level", "b.band", F.floor(F.col("r") / block).cast("int").alias("by"), F.floor(F.col("c") / block).cast("int").alias("bx"), F.struct(((F.col("r") % block) * block + F.col("c") % block).cast("int").alias("at"), F.col("b.v").alias("v")).alias("p"))
    blocks = px.groupBy("fy", "fx", "level", "band", "by", "bx").agg(F.collect_list("p").alias("pixels"), F.count_distinct("p.at").alias("n"))
    blocks = blocks.withColumn("pixels", F.when(F.size("pixels") == F.col("n"), F.col("pixels")).otherwise(F.raise_error(F.lit("two cells are one pixel")).cast("array<struct<at:int,v:double>>"))).drop("n")
    blobs = blocks.mapInArrow(_blocks(bands, block, frame.nodata), "fy int, fx int, level int, band int, by int, bx int, blob binary")
    whole = (frame.rows, frame.cols) <= (side, side) and max(frame.rows, frame.cols) <= side
    named = {f"{i}:DESCRIPTION": d for i, d in enumerate(descriptions or [])}

    def write(key, pdf):
        top, left = int(key[0]) * side, int(key[1]) * side
        rows, cols = min(side, frame.rows - top), min(side, frame.cols - left)
        levels = []
        for level, factor in enumerate([1, *factors]):
            part = pdf[pdf["level"] == level]
            f = Frame(frame.x0 + left * frame.dx, frame.y1 - top * frame.dy, frame.dx, frame.dy, -(-rows // factor), -(-cols // factor), frame.epsg, frame.nodata, frame.tags | named | {"ROW0": top, "COL0": left})
            levels.append((f, {(b, y, x): bytes(blob) for b, y, x, blob in zip(part["band"], part["by"], part["bx"], part["blob"], strict=True)}))
        name = "raster.tif" if whole else f"raster_{key[0]}_{key[1]}.tif"
        os.makedirs(path, exist_ok=True)
        temp = f"{path}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
        Path(temp).write_bytes(assembled(levels, bands, block))
        os.replace(temp, f"{path}/{name}")
        import pandas as pd

        return pd.DataFrame({"name": [f"{path}/{name}"]})

    return sorted(r["name"] for r in blobs.groupBy("fy", "fx").applyInPandas(write, "name string").collect())  # a name for each file


# reading


def _opened(path: str) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(n)

    return read


def _pixels(name: str, image: Image, ty: int, tx: int, band: int, read) -> pa.RecordBatch:
    x = decoded(image, ty, tx, band, read)
    row, col = (a.ravel().astype(np.int32) for a in np.indices(x.shape))
    row, col = row + ty * image.tile_height, col + tx * image.tile_width
    top, left = (int(image.tags.get(k, 0)) if not image.reduced else 0 for k in ("ROW0", "COL0"))
    n, v = len(row), x.ravel()
    return pa.record_batch([pa.array([name] * n, pa.string()), pa.array(row + top, pa.int32()), pa.array(col + left, pa.int32()), pa.array(image.y1 - (row + 0.5) * image.dy), pa.array(image.x0 + (col + 0.5) * image.dx), pa.array(np.full(n, band + 1, np.int32)), pa.array(v, mask=np.isnan(v))], names=["file", "row", "col", "lat", "lon", "band", "value"])


class _Tiles(InputPartition):
    def __init__(self, tiles: list[tuple]):
        self.tiles = tiles


class GeoTiff(DataSource):
    """The source behind read_geotiff(); options band (all if not given) and level (0, or an overview)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(dict(self.options))


class _TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.band = int(options["band"]) - 1 if "band" in options else None
        self.per_task = int(options.get("tiles", TILES_A_TASK))
        #: Least and greatest wanted value of each column that a tile has a range of.
        self.wanted: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("row", "col", "lat", "lon", "band"):
                lo, hi = self.wanted.get(name, (-np.inf, np.inf))
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, f.value), min(hi, f.value)
                elif isinstance(f, In) and f.value:
                    lo, hi = max(lo, min(f.value)), min(hi, max(f.value))
                elif isinstance(f, GreaterThanOrEqual):
                    lo = max(lo, f.value)
                elif isinstance(f, LessThanOrEqual):
                    hi = min(hi, f.value)
                elif isinstance(f, GreaterThan):
                    lo = max(lo, np.nextafter(f.value, np.inf))
                elif isinstance(f, LessThan):
                    hi = min(hi, np.nextafter(f.value, -np.inf))
                self.wanted[name] = lo, hi
            yield f  # Spark still looks at each row

    def _wants(self, **ranges: tuple[float, float]) -> bool:
        return all(lo <= self.wanted.get(k, (lo, hi))[1] and hi >= self.wanted.get(k, (lo, hi))[0] for k, (lo, hi) in ranges.items())

    def partitions(self):
        files = sorted(str(p) for p in Path(self.path).rglob("*.tif*")) if os.path.isdir(self.path) else [self.path]
        tiles = []
        for name in files:
            found = images(_opened(name))
            if self.level >= len(found):
                continue
            i = found[self.level]
            top, left = (int(i.tags.get(k, 0)) if not i.reduced else 0 for k in ("ROW0", "COL0"))
            for ty in range(i.down):
                y0, y1 = ty * i.tile_height, min(i.height, (ty + 1) * i.tile_height) - 1
                if not self._wants(row=(top + y0, top + y1), lat=(i.y1 - (y1 + 0.5) * i.dy, i.y1 - (y0 + 0.5) * i.dy)):
                    continue
                for tx in range(i.across):
                    x0, x1 = tx * i.tile_width, min(i.width, (tx + 1) * i.tile_width) - 1
                    if self._wants(col=(left + x0, left + x1), lon=(i.x0 + (x0 + 0.5) * i.dx, i.x0 + (x1 + 0.5) * i.dx)):
                        tiles += [(name, ty, tx, b) for b in range(i.bands) if self.band in (None, b) and self._wants(band=(b + 1, b + 1))]
        return [_Tiles(tiles[i : i + self.per_task]) for i in range(0, len(tiles), self.per_task)] or [_Tiles([])]

    def read(self, partition):
        known: dict[str, Image] = {}
        for name, ty, tx, band in partition.tiles:
            if name not in known:
                known[name] = images(_opened(name))[self.level]
            yield _pixels(name, known[name], ty, tx, band, _opened(name))


def read_geotiff(spark: SparkSession, path: str, *, band: int | None = None, level: int = 0) -> DataFrame:
    """Pixels of a file, or of all files below a folder; filters on row, col, lat, lon and band decide which tiles are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    r = spark.read.format("geotiff").option("level", level)
    # Spark keeps a source's plan with the frame and renews it only for a query with filters, so there is always one
    return (r if band is None else r.option("band", band)).load(path).where("row >= 0")


def read_stored(spark: SparkSession, path: str, *, band: int = 1, level: int = 0) -> DataFrame:
    """The same from any store that Spark reads: a task takes whole files, so it is meant for many files of bounded size."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                read = lambda at, n, d=data: d.slice(at, min(n, d.size - at)).to_pybytes()
                i = images(read)[level]
                for ty in range(i.down):
                    for tx in range(i.across):
                        yield _pixels(name, i, ty, tx, band - 1, read)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, PIXELS)


def grid_of(pixels: DataFrame) -> DataFrame:
    """Pixels as a grid table: iy from the south, ix from the west, lat, lon of the centres, value."""
    rows = pixels.agg((F.max("row") + F.min("row")).alias("_r"))
    return pixels.crossJoin(F.broadcast(rows)).select((F.col("_r") - F.col("row")).cast("int").alias("iy"), F.col("col").alias("ix"), "lat", "lon", "value")  # one row


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
