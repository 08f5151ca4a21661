"""Joins of points with polygons and with their nearest stations, by quadtrees that Spark grows a step at a time.

Both trees end in leaves with few edges or few stations each, so a point meets a handful of them however many there are,
and the join is an equi-join by cell. A step splits each cell that still holds too much into SPLIT x SPLIT children; its
rows are edges or stations, never whole polygons, so one polygon of millions of vertices is dealt over all tasks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, finite, haversine_km
from tidemark.plans.cut import cut

#: Children along each side of a cell that is split, and steps at most: 4**10 cells along a side of the root.
SPLIT, STEPS = 4, 10
#: Edges of a polygon in one leaf, and stations in one leaf; leaves of the last step may hold more.
MOST_EDGES, MOST_STATIONS = 12, 12
#: Stations of a cell that one task refines, and stations that are all rivals of each other.
LOCAL, ALL_RIVALS = 20_000, 64
#: Step of the cells that tell at which steps there are leaves in them.
MAP = 3
#: Leaves go to all executors up to so many bytes, counted; beyond that the points are shuffled to them.
BROADCAST_BYTES = 64 << 20
#: A cell's box reaches so much of its size beyond its sides, more than coordinates are rounded.
MARGIN = 1e-6
#: Where in a cell its reference point lies; no vertex of a real polygon is likely to share a coordinate with it.
REF = (0.5381966011250105, 0.4721359549995794)


@dataclass(frozen=True)
class Leaves:
    """Leaves of a tree: the cells, the steps at which there are any, and how many bytes they take."""

    cells: DataFrame
    steps: tuple[int, ...]
    bytes: int
    x0: float = 0.0
    y0: float = 0.0
    size: float = 0.0

    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES


def _leaves(found: list[DataFrame], items: Column, width: int, **root) -> Leaves:
    cells = reduce(DataFrame.unionByName, found)
    seen = cells.groupBy("step").agg(F.count("*").alias("n"), F.sum(items).alias("items")).collect()  # a row for each step
    return Leaves(cells, tuple(sorted(r["step"] for r in seen)), sum(64 * r["n"] + width * (r["items"] or 0) for r in seen), **root)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores: they are few bytes and much work, so partitions of bytes would leave most cores idle."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def _children(c: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPLIT - 1)), lambda i: c * SPLIT + i))


# polygons


def edges_of(polygons: DataFrame, id_col: str, rings: str = "rings") -> DataFrame:
    """polygon, x1, y1, x2, y2 of each edge; `rings` is an array of closed rings of structs or arrays (lon, lat)."""
    ring = polygons.select(F.col(id_col).alias("polygon"), F.explode(rings).alias("r"))
    point = ring.select("polygon", F.posexplode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r") - 1).alias("b"))).alias("i", "e")).where("e.a is not null and e.b is not null")
    names = polygons.select(F.explode(F.col(rings)).alias("r")).select(F.explode("r").alias("p")).schema["p"].dataType
    keys = names.names[:2] if hasattr(names, "names") else (0, 1)
    at = lambda c, k: F.col(f"e.{c}")[k].cast("double")
    return point.select("polygon", at("a", keys[0]).alias("x1"), at("a", keys[1]).alias("y1"), at("b", keys[0]).alias("x2"), at("b", keys[1]).alias("y2"))


def _at(e, y: Column) -> Column:
    """Where an edge crosses the parallel y, in the words of in_polygon(), so that both round alike."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]


def _turns(e, x: Column, y: Column, rx: Column, ry: Column) -> Column:
    """Whether an edge changes the crossing parity between the reference (rx, ry) and (x, y).

    The way goes up or down at rx and then along y. Along y an edge counts if it crosses y between x and rx. At rx it
    counts if it crosses the meridian rx between ry and y; on which side of a parallel it does so is asked of the same
    expression as its place on that parallel, so the parities of all points agree with those from all edges."""
    straddles = lambda v: (e["y1"] > v) != (e["y2"] > v)
    along = F.coalesce(straddles(y) & ((x < _at(e, y)) != (rx < _at(e, y))), F.lit(False))
    rising = (e["x2"] > e["x1"]) == (e["y2"] > e["y1"])
    above = lambda v: F.when(straddles(v), F.when(rising, ~(rx < _at(e, v))).otherwise(rx < _at(e, v))).otherwise(e["y1"] > v)
    up = ((e["x1"] > rx) != (e["x2"] > rx)) & (above(y) != above(ry))
    return along != up


def _on(e, x: Column, y: Column) -> Column:
    return ((x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"]) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def polygon_cover(edges: DataFrame, *, most: int = MOST_EDGES, steps: int = STEPS) -> Leaves:
    """Cells inside each polygon (no edges) and on its border (with the edges that touch them); `edges` as from edges_of().

    A cell knows whether its reference point is inside. A child's follows from its parent's by the parent's edges alone,
    as the way between the two stays in the parent. Edges with null or non-finite ends are left out."""
    good = [finite(c).isNotNull() for c in ("x1", "y1", "x2", "y2")]
    ends = ["x1", "y1", "x2", "y2"]
    edges = cut(_spread(edges.where(reduce(lambda a, b: a & b, good)), "polygon", *ends))
    b = edges.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    west, south, east, north = (0.0, 0.0, 1.0, 1.0) if b[0] is None else b
    size = max(east - west, north - south, 1e-9) * 1.001
    x0, y0 = west - size * 0.0005, south - size * 0.0005
    # the root's reference lies beyond all polygons; the size of a cell is a column, so all steps share their compiled code
    now = edges.select("*", F.lit(size).alias("s"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(False).alias("odd"), F.lit(x0 - size).alias("rx"), F.lit(y0 - size).alias("ry"))
    found = []
    for step in range(1, steps + 1):
        s = F.col("s")
        kids = now.withColumn("s", F.col("s") / SPLIT).withColumn("cx", _children(F.col("cx"))).withColumn("cy", _children(F.col("cy")))
        nx, ny = x0 + (F.col("cx") + REF[0]) * s, y0 + (F.col("cy") + REF[1]) * s
        e = {c: F.col(c) for c in ends}
        kids = kids.withColumns({"nx": nx, "ny": ny}).withColumn("turn", _turns(e, F.col("nx"), F.col("ny"), F.col("rx"), F.col("ry")))
        mx, my, half = x0 + (F.col("cx") + 0.5) * s, y0 + (F.col("cy") + 0.5) * s, s * (0.5 + MARGIN)
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        apart = (F.greatest("x1", "x2") < mx - half) | (F.least("x1", "x2") > mx + half) | (F.greatest("y1", "y2") < my - half) | (F.least("y1", "y2") > my + half)
        apart = apart | (F.abs(dx * (my - F.col("y1")) - dy * (mx - F.col("x1"))) > half * (F.abs(dx) + F.abs(dy)) * (1 + MARGIN))
        kids = kids.withColumn("here", ~apart)
        cells = kids.groupBy("polygon", "cx", "cy").agg((F.first("odd") != (F.sum(F.col("turn").cast("int")) % 2 == 1)).alias("odd"), F.sum(F.col("here").cast("int")).alias("n"))
        cells = cut(cells)
        inside = cells.where("n = 0 and odd").select("polygon", F.lit(step).alias("step"), "cx", "cy", "odd", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>").alias("edges"))
        held = kids.where("here").drop("odd", "rx", "ry", "turn", "here").withColumnsRenamed({"nx": "rx", "ny": "ry"})
        held = held.join(cells.where("n > 0").select("polygon", "cx", "cy", "odd", "n"), ["polygon", "cx", "cy"])
        held = cut(_spread(held, "polygon", *ends))
        full = F.col("n") > (most if step < steps else 1 << 62)
        border = held.where(~full).groupBy("polygon", "cx", "cy").agg(F.first("odd").alias("odd"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        found += [inside, border.select("polygon", F.lit(step).alias("step"), "cx", "cy", "odd", "edges")]
        now = held.where(full).drop("n")
        if now.isEmpty():
            break
    return _leaves([cut(reduce(DataFrame.unionByName, found))], F.size(F.coalesce("edges", F.array())), 40, x0=x0, y0=y0, size=size)


def polygon_join(points: DataFrame, cover: Leaves, *, x="lon", y="lat", out: str = "polygon") -> DataFrame:
    """Each point once for each polygon that it lies strictly inside of, by crossing parity over all its rings, so holes
    count; a point on an edge is outside. Points without coordinates are in none. The rows equal those of in_polygon()."""
    keys = [F.struct(F.lit(s).alias("step"), F.floor((col(x) - cover.x0) / (cover.size / SPLIT**s)).alias("cx"), F.floor((col(y) - cover.y0) / (cover.size / SPLIT**s)).alias("cy")) for s in cover.steps]
    if not keys:
        return points.withColumn(out, F.lit(None).cast(cover.cells.schema["polygon"].dataType)).where("false")
    near = points.where(finite(x).between(cover.x0, cover.x0 + cover.size) & finite(y).between(cover.y0, cover.y0 + cover.size))
    near = near.withColumn("_k", F.explode(F.array(*keys)))
    cells = cover.cells.select(F.struct("step", "cx", "cy").alias("_k"), F.col("polygon").alias("_p"), F.struct("odd", "edges").alias("_cell"))
    both = near.join(F.broadcast(cells) if cover.small() else cells, "_k")
    side = F.element_at(F.lit([cover.size / SPLIT**s for s in range(STEPS + 1)]), F.col("_k.step") + 1)
    rx, ry = cover.x0 + (F.col("_k.cx") + REF[0]) * side, cover.y0 + (F.col("_k.cy") + REF[1]) * side
    both = both.withColumns({"_rx": rx, "_ry": ry})
    start = F.struct(F.col("_cell.odd").alias("odd"), F.lit(False).alias("on"))
    px, py = col(x).cast("double"), col(y).cast("double")
    fold = F.aggregate("_cell.edges", start, lambda s, e: F.struct((s["odd"] != _turns(e, px, py, F.col("_rx"), F.col("_ry"))).alias("odd"), (s["on"] | _on(e, px, py)).alias("on")), lambda s: s["odd"] & ~s["on"])
    return both.where(F.col("_cell.edges").isNull() | fold).withColumn(out, F.col("_p")).drop("_k", "_p", "_cell", "_rx", "_ry")


# stations


def _unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def _face(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Face of the cube around the earth that a direction meets, and where, from 0 to 1 each way."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    face = F.when(on_x, F.when(x > 0, 0).otherwise(1)).when(on_y, F.when(y > 0, 2).otherwise(3)).otherwise(F.when(z > 0, 4).otherwise(5))
    u = F.when(on_x, y / ax).when(on_y, x / ay).otherwise(x / az)
    v = F.when(on_x, z / ax).when(on_y, z / ay).otherwise(y / az)
    return face, (u + 1) / 2, (v + 1) / 2


def _split(face: int, n: int, cx: int, cy: int, at: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray]]:
    """The children of a cell (n along a side of its face) and, for each, which of the stations at `at` (x, y, z by rows) may be among
    the k nearest of a point in it: those that fewer than k rivals beat at all four corners. All stations are rivals of a few;
    of many, those nearest to a child's middle and corners. Any rivals are right, as each is a station."""
    kid = np.arange(SPLIT * SPLIT)
    kx, ky = cx * SPLIT + kid // SPLIT, cy * SPLIT + kid % SPLIT
    places = np.array([(0.5, 0.5), *((i, j) for i in (-MARGIN, 1 + MARGIN) for j in (-MARGIN, 1 + MARGIN))])
    p, q = ((c[:, None] + places[None, :, i]) / (n * SPLIT) * 2 - 1 for i, c in enumerate((kx, ky)))
    sign = np.full(p.shape, 1.0 if face % 2 == 0 else -1.0)
    d = sum(c[:, :, None] * x for c, x in zip(((sign, p, q), (p, sign, q), (p, q, sign))[face // 2], at, strict=True))  # child, place, station
    middle, corners, m = d[:, 0], d[:, 1:], at.shape[1]
    if m <= ALL_RIVALS:
        rivals = np.tile(np.arange(m), (len(kid), 1))
    else:
        rivals = np.sort(np.concatenate([np.argpartition(-middle, min(k + 3, m - 1), axis=1)[:, : k + 4], corners.argmax(2)], 1), 1)
    beaten = np.zeros(middle.shape, np.int32)
    for r in range(rivals.shape[1]):
        one = rivals[:, r]
        wins = (np.take_along_axis(corners, one[:, None, None], 2) - corners > 1e-14).all(1)
        beaten += wins & (one != rivals[:, r - 1])[:, None] if r else wins  # a rival counts once
    return [(int(kx[c]), int(ky[c]), np.flatnonzero(beaten[c] < k)) for c in kid]


def _refine(k: int, most: int, steps: int):
    """A function of the stations of one cell: of a cell that is dealt into several `parts` its children, else all leaves below it."""

    def run(cell: pa.Table) -> pa.Table:
        face, step, cx, cy, parts = (cell[c][0].as_py() for c in ("face", "step", "cx", "cy", "parts"))
        ids, xyz = cell["id"].to_numpy(), np.stack([cell[c].to_numpy() for c in "xyz"])
        todo, out = [(step, cx, cy, np.arange(len(ids)), parts > 1)], []
        while todo:
            step, cx, cy, at, whole = todo.pop()
            if step == steps or not (whole or len(at) > most):
                out.append((step, cx, cy, at, True))
                continue
            kids = _split(face, SPLIT**step, cx, cy, xyz[:, at], k)
            (out if whole else todo).extend((step + 1, x, y, at[kept], False) for x, y, kept in kids)
        sizes, at = [len(r[3]) for r in out], np.concatenate([r[3] for r in out])
        column = lambda i, kind: np.repeat(np.array([r[i] for r in out], kind), sizes)
        return pa.table({"face": np.full(len(at), face, np.int32), "step": column(0, np.int32), "cx": column(1, np.int64), "cy": column(2, np.int64), "leaf": pa.array(column(4, bool)), "id": ids[at], **{c: xyz[i, at] for i, c in enumerate("xyz")}})

    return run


def station_cover(stations: DataFrame, *, k: int = 1, s_lat: str = "s_lat", s_lon: str = "s_lon", order: list | None = None, most: int | None = None, steps: int = STEPS) -> Leaves:
    """Cells of the six faces of a cube around the earth, each with all stations that are among the k nearest of any of its points.

    The points of a cell are positive combinations of its corners, and the sign of x * (t - s) tells whether x is nearer
    to t than to s. So where t is nearer at all four corners it is nearer in the whole cell, and a station that k
    others beat in this way goes. No cell sees a pole or the meridian of 180 degrees as anything special. Of stations at
    one place the first k by `order` (default: all columns) count; stations without a place take no part.

    A cell of at most LOCAL stations is refined to its leaves by one task; the stations of a larger one are dealt at random over
    tasks, each of which prunes its share for each child by rivals of that share."""
    most, names = most or MOST_STATIONS + 2 * k, stations.columns
    from pyspark.sql import Window

    placed = stations.where(finite(s_lat).isNotNull() & finite(s_lon).isNotNull())
    keyed = placed.select(F.struct(*(order or names)).alias("o"), F.struct(*names).alias("s"), finite(s_lat).alias("lat"), finite(s_lon).alias("lon"))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("o"))).where(F.col("nth") <= k).drop("nth")
    keyed = cut(keyed.withColumn("id", F.monotonically_increasing_id()))
    x, y, z = _unit(F.col("lat"), F.col("lon"))
    where = ["face", "step", "cx", "cy"]
    now = keyed.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("face"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(False).alias("leaf"), "id", x.alias("x"), y.alias("y"), z.alias("z"))
    found = []
    while True:
        large = cut(now.groupBy(*where).agg(F.count("*").alias("held")).where((F.col("held") > LOCAL) & (F.col("step") < steps)).select(*where, F.ceil(F.col("held") / LOCAL).cast("int").alias("parts")))
        some = not large.isEmpty()
        dealt = now.join(F.broadcast(large), where, "left") if some else now.withColumn("parts", F.lit(None).cast("int"))  # a row for each LOCAL stations at most
        dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        done = cut(_spread(dealt, *where, "part").groupBy(*where, "part").applyInArrow(_refine(k, most, steps), now.schema))
        found.append(done.where("leaf"))
        if not some:
            break
        now = done.where("not leaf")
    leaves = reduce(DataFrame.unionByName, found).select(*where, "id").join(keyed, "id")
    cells = leaves.groupBy(*where).agg(F.collect_list(F.struct("lat", "lon", "o", "s")).alias("near"))
    return _leaves([cut(cells)], F.size("near"), 32 + 16 * len(names))


def _at_map(c: str) -> Column:
    """The places along one side, at step MAP, of the cell of step MAP that a leaf lies in, or of those that lie in it."""
    width = F.pow(F.lit(SPLIT), F.lit(MAP) - F.col("step"))
    return F.sequence(F.floor(F.col(c) * width), F.floor(F.col(c) * width + F.greatest(width, F.lit(1.0)) - 1)).alias(c)


def nearest(points: DataFrame, cover: Leaves, *, k: int = 1, lat="lat", lon="lon", out: str = "near") -> DataFrame:
    """Adds `out`, an array of the k nearest stations (distance_km, then the station's columns), nearest first.

    A tie goes to the first by the order of the cover, which must be made for this k or a larger one. Points without a
    place, and all points where there are no stations, get null."""
    a, o = finite(lat), finite(lon)
    face, u, v = _face(*_unit(a, o))
    here = points.withColumn("_f", F.struct(face.alias("face"), u.alias("u"), v.alias("v")))
    key = lambda s: F.struct(F.lit(s).alias("step"), F.col("_f.face").alias("face"), *(F.least(F.lit(SPLIT**s - 1).cast("long"), F.floor(F.col(f"_f.{c}") * SPLIT**s)).alias(n) for c, n in (("u", "cx"), ("v", "cy"))))
    empty = cover.cells.select(F.col("near").alias("n")).schema["n"].dataType.elementType["s"].dataType
    if not cover.steps:
        return points.withColumn(out, F.lit(None).cast(f"array<struct<distance_km:double,{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in empty.fields)}>>"))
    placed = a.isNotNull() & o.isNotNull()
    cells = cover.cells.select(F.struct("step", "face", "cx", "cy").alias("_k"), F.col("near").alias("_n"))
    at = here.where(placed)
    if cover.small():
        both = at.withColumn("_k", F.explode(F.array(*(key(s) for s in cover.steps)))).join(F.broadcast(cells), "_k")
    else:  # points are shuffled, so a point goes only to the steps that there are in its part of the face
        parts = cover.cells.select("step", "face", *(_at_map(c) for c in ("cx", "cy")))
        parts = parts.withColumn("cx", F.explode("cx")).withColumn("cy", F.explode("cy")).groupBy(F.struct("face", "cx", "cy").alias("_m")).agg(F.collect_set("step").alias("_s"))
        at = at.withColumn("_m", key(MAP).dropFields("step")).join(F.broadcast(parts), "_m")  # 6 * SPLIT ** (2 * MAP) rows at most
        both = at.withColumn("_s", F.explode("_s")).withColumn("_k", F.element_at(F.array(*(key(s) for s in range(STEPS + 1))), F.col("_s") + 1)).drop("_m", "_s").join(cells, "_k")
    far = F.transform("_n", lambda s: F.struct(haversine_km(lat, lon, s["lat"], s["lon"]).alias("km"), s["o"].alias("o"), s["s"].alias("s")))
    first = F.slice(F.array_sort(far), 1, k) if k > 1 else F.array(F.array_min(far))
    got = both.withColumn(out, F.transform(first, lambda s: F.struct(s["km"].alias("distance_km"), *(s["s"][f.name].alias(f.name) for f in empty.fields)))).drop("_f", "_k", "_n")
    return got.unionByName(points.where(~placed), allowMissingColumns=True)


def nearest_any(points: DataFrame, stations: DataFrame, *, lat="lat", lon="lon", s_lat: str = "s_lat", s_lon: str = "s_lon", order: list | None = None) -> DataFrame:
    """Each point with distance_km and the columns of its nearest station, of any number of stations."""
    got = nearest(points, station_cover(stations, s_lat=s_lat, s_lon=s_lon, order=order), lat=lat, lon=lon, out="_near")
    return got.select(*points.columns, F.col("_near")[0]["distance_km"].alias("distance_km"), *(F.col("_near")[0][c].alias(c) for c in stations.columns))


def idw(points: DataFrame, controls: DataFrame, value: str, *, k: int = 8, power: float = 2.0, lat="lat", lon="lon", s_lat: str = "s_lat", s_lon: str = "s_lon", out: str = "value", order: list | None = None) -> DataFrame:
    """Adds `out`, the mean of the k nearest controls by inverse distance, and <out>_reach_km, how far the farthest of them is.

    Of controls equally far the first by `order` (columns; default: value and place) count. Controls at the point itself (within 1e-9 km) give their mean. Controls without a finite value take no part; points
    without a place, and all points where there are no controls, get null."""
    ranks = [col(c).alias(f"o{i}") for i, c in enumerate(order or [])]
    good = controls.select(finite(value).alias("v"), F.col(s_lat), F.col(s_lon), *ranks).where("v is not null")
    near = nearest(points, station_cover(good, k=k, s_lat=s_lat, s_lon=s_lon, order=[f"o{i}" for i in range(len(ranks))]), k=k, lat=lat, lon=lon, out="_near")
    fold = lambda of, f: F.aggregate(of, F.lit(0.0), lambda a, s: a + f(s))
    weight = lambda s: F.pow(s["distance_km"], F.lit(-power))
    here = F.filter("_near", lambda s: s["distance_km"] <= 1e-9)
    away = fold(F.col("_near"), lambda s: weight(s) * s["v"]) / fold(F.col("_near"), weight)
    found = F.when(F.size(here) > 0, fold(here, lambda s: s["v"]) / F.size(here)).when(F.size("_near") > 0, away)
    return near.withColumns({out: found, f"{out}_reach_km": F.array_max(F.transform("_near", lambda s: s["distance_km"]))}).drop("_near")


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
