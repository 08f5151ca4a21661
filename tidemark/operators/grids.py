"""Grids as long tables (iy, ix, lat, lon, value), point sampling, resampling, and gridding of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, finite, utm_epsg, utm_forward, utm_inverse
from tidemark.operators.joins import nearest_station

#: Cells of a grid that is sent to all executors at most; larger grids are joined by shuffle.
SMALL_CELLS = 2_000_000
MOST_CELLS = 50_000_000


@dataclass(frozen=True)
class Axis:
    lat0: float
    lon0: float
    dlat: float
    dlon: float
    ny: int
    nx: int


def axis_of(grid: DataFrame) -> Axis:
    """The regular lattice that a grid table lies on."""
    r = grid.agg(*(f(c) for c in ("iy", "ix", "lat", "lon") for f in (F.min, F.max))).first()
    y0, y1, x0, x1, a0, a1, o0, o1 = r
    return Axis(a0, o0, (a1 - a0) / max(1, y1 - y0), (o1 - o0) / max(1, x1 - x0), y1 - y0 + 1, x1 - x0 + 1)


def lattice(spark: SparkSession, a: Axis) -> DataFrame:
    """All nodes; rows are made where they are used."""
    n = spark.range(a.ny * a.nx).select((F.col("id") / a.nx).cast("int").alias("iy"), (F.col("id") % a.nx).cast("int").alias("ix"))
    return n.withColumns({"lat": a.lat0 + F.col("iy") * F.lit(a.dlat), "lon": a.lon0 + F.col("ix") * F.lit(a.dlon)})


def _near(df: DataFrame, cells: DataFrame, on: list[str], size: int) -> DataFrame:
    return df.join(F.broadcast(cells) if size <= SMALL_CELLS else cells, on, "left")


def corner_cells(grid: DataFrame) -> DataFrame:
    """One row for each square of four nodes, with its corner values; made once for many samplings."""
    at = lambda dy, dx, name: grid.select((F.col("iy") - dy).alias("_iy"), (F.col("ix") - dx).alias("_ix"), F.when(F.lit(True), finite("value")).alias(name))
    corners = [at(0, 0, "v00"), at(0, 1, "v01"), at(1, 0, "v10"), at(1, 1, "v11")]
    rows = corners[0]
    for c in corners[1:]:
        rows = rows.unionByName(c, allowMissingColumns=True)
    return rows.groupBy("_iy", "_ix").agg(*(F.max(v).alias(v) for v in ("v00", "v01", "v10", "v11")))


def sample_bilinear(points: DataFrame, grid: DataFrame, axis: Axis, out: str, *, lat="lat", lon="lon") -> DataFrame:
    """Bilinear value at each point; null outside the nodes and where any corner is null. The last nodes are inside."""
    fy, fx = (col(lat) - axis.lat0) / axis.dlat, (col(lon) - axis.lon0) / axis.dlon
    inside = fy.between(0, axis.ny - 1) & fx.between(0, axis.nx - 1)
    low = lambda f, n: F.greatest(F.lit(0), F.least(F.floor(f), F.lit(n - 2))).cast("int")
    at = points.withColumns({"_iy": F.when(inside, low(fy, axis.ny)), "_ix": F.when(inside, low(fx, axis.nx))})
    at = _near(at, corner_cells(grid), ["_iy", "_ix"], axis.ny * axis.nx)
    ty, tx = fy - F.col("_iy"), fx - F.col("_ix")
    v = F.col("v00") * (1 - ty) * (1 - tx) + F.col("v01") * (1 - ty) * tx + F.col("v10") * ty * (1 - tx) + F.col("v11") * ty * tx
    return at.withColumn(out, v).drop("_iy", "_ix", "v00", "v01", "v10", "v11")


def sample_nearest(points: DataFrame, grid: DataFrame, axis: Axis, out: str, *, lat="lat", lon="lon", most: float = 1e4) -> DataFrame:
    """Value of the cell that holds the point (nodes are cell centres); values beyond `most` are nodata."""
    at = points.withColumns({"_iy": F.floor((col(lat) - axis.lat0) / axis.dlat + 0.5).cast("int"), "_ix": F.floor((col(lon) - axis.lon0) / axis.dlon + 0.5).cast("int")})
    cells = grid.select(F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), F.when(F.abs(finite("value")) <= most, finite("value")).alias(out))
    return _near(at, cells, ["_iy", "_ix"], axis.ny * axis.nx).drop("_iy", "_ix")


def trim_to_valid(grid: DataFrame) -> DataFrame:
    """Without rows and columns at the margin that hold no value."""
    ok = finite("value").isNotNull()
    b = grid.where(ok).agg(F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    return grid.join(F.broadcast(b), F.col("iy").between(F.col("y0"), F.col("y1")) & F.col("ix").between(F.col("x0"), F.col("x1"))).drop("y0", "y1", "x0", "x1")


def clip_to_box(grid: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Nodes in the box, borders included; an error if there are none."""
    out = grid.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    if out.isEmpty():
        raise ValueError("the box holds no node")
    return out


def resample(grid: DataFrame, axis: Axis, step: float) -> DataFrame:
    """Bilinear values on a lattice of `step` degrees from the same corner."""
    ny, nx = (int((n - 1) * d / step + 1e-9) + 1 for n, d in ((axis.ny, axis.dlat), (axis.nx, axis.dlon)))
    return sample_bilinear(lattice(grid.sparkSession, Axis(axis.lat0, axis.lon0, step, step, ny, nx)), grid, axis, "value")


def grid_statistics(grid: DataFrame) -> DataFrame:
    """n, mean, min, max and population deviation of finite values."""
    v = finite("value")
    return grid.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("std"))


def validated(grid: DataFrame, published: dict[str, float], tolerance: float = 0.02, n: int | None = None) -> DataFrame:
    """grid_statistics() with ok: mean, low and std within `tolerance` of the published ones and, if given, the node count. The maximum decides nothing."""
    s = grid_statistics(grid)
    ok = F.lit(True)
    for k in ("mean", "low", "std"):
        if k in published:
            ok = ok & (F.abs(F.col(k) - published[k]) <= tolerance)
    return s.withColumn("ok", ok if n is None else ok & (F.col("n") == n))


def grid_cells(points: DataFrame, value: str, x: Column | str, y: Column | str, step: float) -> DataFrame:
    """Median and count of the points of each cell (row from the north, col from the west) of planar coordinates."""
    pts = points.select(finite(value).alias("_v"), finite(x).alias("_x"), finite(y).alias("_y")).where("_v is not null and _x is not null and _y is not null")
    b = pts.agg((F.floor(F.min("_x") / step) * step).alias("x0"), (F.ceil(F.max("_y") / step) * step).alias("top"), F.max("_y").alias("ymax"), F.max("_x").alias("xmax"), F.min("_y").alias("ymin"))
    b = b.withColumn("y1", F.when(F.col("top") == F.col("ymax"), F.col("top") + step).otherwise(F.col("top")))
    size = b.select(((F.floor((F.col("xmax") - F.col("x0")) / step) + 1) * (F.floor((F.col("y1") - F.col("ymin")) / step) + 1)).alias("n")).first()["n"]
    if size is not None and size > MOST_CELLS:
        raise ValueError(f"{size} cells are more than {MOST_CELLS}")
    at = pts.crossJoin(F.broadcast(b.select("x0", "y1")))  # one row
    row, column = F.floor((F.col("y1") - F.col("_y")) / step).cast("int"), F.floor((F.col("_x") - F.col("x0")) / step).cast("int")
    return at.groupBy(row.alias("row"), column.alias("col"), "x0", "y1").agg(F.median("_v").alias("value"), F.count("*").alias("n_points"))


def grid_points(points: DataFrame, value: str, step: float, *, lat="lat", lon="lon", epsg: int | None = None) -> DataFrame:
    """grid_cells() in the UTM zone of the median point, with the corner of each cell in degrees."""
    if epsg is None:
        m = points.where(finite(value).isNotNull()).agg(F.median(lat).alias("a"), F.median(lon).alias("o")).select(utm_epsg("a", "o").alias("e")).first()
        epsg = m["e"] if m and m["e"] else 32631
    x, y = utm_forward(lat, lon, F.lit(epsg))
    cells = grid_cells(points.withColumns({"_ux": x, "_uy": y}), value, "_ux", "_uy", step)
    a, o = utm_inverse(F.col("x0") + F.col("col") * step, F.col("y1") - F.col("row") * step, F.lit(epsg))
    return cells.withColumns({"epsg": F.lit(epsg), "lat": a, "lon": o})


def raster_stats(cells: DataFrame) -> DataFrame:
    return cells.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count("value").alias("valid_cells"), F.sum("n_points").alias("points"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("median"))


def corrector_grid(spark: SparkSession, axis: Axis, known: list[tuple]) -> DataFrame:
    """The nearest station's corrector and sigma at each node of a lattice."""
    at = nearest_station(lattice(spark, axis), known)
    return at.select("iy", "ix", "lat", "lon", F.col("c_station_m").alias("value"), "sigma_m", "station")


def sample_tiles(points: DataFrame, tiles: DataFrame, per_degree: int, out: str, *, lat="lat", lon="lon", most: float = 1e4) -> DataFrame:
    """Pixel values from tiles of one degree: `tiles` has tile_lat, tile_lon, row (from the north), col and value, and may
    be partitioned by the first two, so only tiles with points are read. Missing tiles and nodata give null."""
    y, x = F.floor(col(lat)), F.floor(col(lon))
    row = F.least(F.lit(per_degree - 1), F.floor((y + 1 - col(lat)) * per_degree)).cast("int")
    column = F.least(F.lit(per_degree - 1), F.floor((col(lon) - x) * per_degree)).cast("int")
    at = points.withColumns({"_ty": y.cast("int"), "_tx": x.cast("int"), "_row": row, "_col": column})
    cells = tiles.select(F.col("tile_lat").alias("_ty"), F.col("tile_lon").alias("_tx"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.when(F.abs(finite("value")) <= most, finite("value")).alias(out))
    return at.join(cells, ["_ty", "_tx", "_row", "_col"], "left").drop("_ty", "_tx", "_row", "_col")


def footprint(cells: DataFrame, step: float) -> DataFrame:
    """The closed ring of a raster's corners in degrees, counter-clockwise; `cells` as from grid_points()."""
    b = cells.agg(F.first("x0").alias("x0"), F.first("y1").alias("y1"), F.first("epsg").alias("epsg"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    west, north, east, south = F.col("x0"), F.col("y1"), F.col("x0") + F.col("cols") * step, F.col("y1") - F.col("rows") * step
    ring = []
    for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south)):
        a, o = utm_inverse(x, y, F.col("epsg"))
        ring.append(F.struct(o.alias("lon"), a.alias("lat")))
    return b.select("rows", "cols", F.array(*ring).alias("ring"))
