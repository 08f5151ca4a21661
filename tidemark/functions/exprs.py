"""Column functions: geometry on the sphere, masks, labels, flags, names of files and tiles, map projection. All stay in the JVM."""

from __future__ import annotations

import json
import math
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0088
NMAD = 1.4826
MEDIAN_SE = 1.2533
INVALID = 1e30
GROUND_TRACKS = {10: "gt1l", 20: "gt1r", 30: "gt2l", 40: "gt2r", 50: "gt3l", 60: "gt3r"}
GRANULE = r"^(ATL\d{2})_(\d{14})_(\d{4})(\d{2})(\d{2})_(\d{3})_(\d{2})\.h5$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value as double, or null if it is null, NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def masked(c: str | Column) -> Column:
    """A sensor value: text that is no number, and the fill values of 1e30 and beyond, become null."""
    x = col(c).try_cast("double")
    return F.when(F.abs(x) < INVALID, x)


def truthy(c: str | Column) -> Column:
    """Null counts as false."""
    return F.coalesce(col(c), F.lit(False))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= atol + rtol * F.abs(col(b))


def beam_label(gt) -> Column:
    """Ground track number to beam name; others become their number as text."""
    table = F.create_map(*(F.lit(x) for kv in GROUND_TRACKS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(gt).cast("int")), col(gt).cast("string"))


def period_label(date, last_before: str, first_after: str, names=("PRE_BREACH", "BREACH_DRAWDOWN", "POST_BREACH")) -> Column:
    """One of three regimes: up to and with `last_before`; before `first_after`; after."""
    d = F.to_date(col(date))
    return F.when(d <= F.lit(last_before).cast("date"), names[0]).when(d < F.lit(first_after).cast("date"), names[1]).when(d.isNotNull(), names[2])


def transect(rgt, beam) -> Column:
    return F.concat_ws("_", col(rgt).cast("string"), col(beam))


def reservoir_flags(n, mad, spread, length, noise, slope, *, min_points=20, max_mad=0.25, max_range=1.0, min_length=2.0, max_noise=0.5, max_slope=0.05) -> Column:
    """Names of the failed checks, joined by |; null measures fail nothing, and a slope counts only on tracks that are not short."""
    n, mad, spread, length, noise, slope = map(col, (n, mad, spread, length, noise, slope))
    short = F.coalesce(length < min_length, F.lit(False))
    return F.concat_ws(
        "|",
        F.when(n < min_points, "too_few_points"),
        F.when(mad > max_mad, "mad"),
        F.when(spread > max_range, "range"),
        F.when(short, "track_too_short"),
        F.when(noise > max_noise, "stdev"),
        F.when(~short & (F.abs(slope) > max_slope), "slope"),
    )


def local_flags(n, nmad, deviation, *, min_points=5, max_nmad=0.25, max_deviation=3.0) -> Column:
    """Checks of a local pass: too few points, noise missing or large, or a level far from the reservoir's."""
    return F.concat_ws(
        "|",
        F.when(col(n) < min_points, "too_few_points"),
        F.when(F.coalesce(col(nmad) > max_nmad, F.lit(True)), "nmad"),
        F.when(F.abs(col(deviation)) > max_deviation, "implausible_level"),
    )


def granule_parts(name) -> dict[str, Column]:
    """Columns of a granule's file name; all null if the name does not match."""
    ok = F.col(name).rlike(GRANULE) if isinstance(name, str) else name.rlike(GRANULE)
    part = lambda i: F.when(ok, F.regexp_extract(col(name), GRANULE, i))
    return {
        "product": part(1),
        "acquired": F.when(ok, F.try_to_timestamp(part(2), F.lit("yyyyMMddHHmmss"))),
        "rgt": part(3).cast("int"),
        "cycle": part(4).cast("int"),
        "region_no": part(5).cast("int"),
        "release": part(6),
        "version": part(7),
    }


def angle(text) -> Column:
    """Degrees of 12.5 or of 12°30'00\" and the like; null if neither."""
    t = F.trim(col(text))
    dms = r"^([+-]?)(\d+)[° ]\s*(\d+)['′ ]\s*(\d+(?:\.\d+)?)[\"″]?$"
    sign = F.when(F.regexp_extract(t, dms, 1) == "-", -1.0).otherwise(1.0)
    part = lambda i: F.regexp_extract(t, dms, i).try_cast("double")
    return F.when(t.rlike(dms), sign * (part(2) + part(3) / 60 + part(4) / 3600)).otherwise(t.try_cast("double"))


def _hemisphere(v, width: int, plus: str, minus: str) -> Column:
    return F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(v).cast("int").cast("string"), width, "0"))


def cop30_tile(lat, lon) -> Column:
    y, x = F.floor(col(lat)), F.floor(col(lon))
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), _hemisphere(y, 2, "N", "S"), F.lit("_00_"), _hemisphere(x, 3, "E", "W"), F.lit("_00_DEM"))


def fabdem_tile(lat, lon) -> Column:
    y, x = F.floor(col(lat)), F.floor(col(lon))
    return F.concat(_hemisphere(y, 2, "N", "S"), _hemisphere(x, 3, "E", "W"), F.lit("_FABDEM_V1-2.tif"))


def fabdem_zip(lat, lon) -> Column:
    y, x = 10 * F.floor(col(lat) / 10), 10 * F.floor(col(lon) / 10)
    corner = lambda a, b: F.concat(_hemisphere(a, 2, "N", "S"), _hemisphere(b, 3, "E", "W"))
    return F.concat(corner(y, x), F.lit("-"), corner(y + 10, x + 10), F.lit("_FABDEM_V1-2.zip"))


def utm_epsg(lat, lon) -> Column:
    """Zone by longitude alone, without the exceptions of Norway and Svalbard."""
    zone = F.least(F.lit(60), F.floor((col(lon) + 180) / 6) + 1)
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


# WGS 84 and its Krueger series.
_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def utm_forward(lat, lon, epsg) -> tuple[Column, Column]:
    """Easting and northing in metres in the zone of an EPSG number 326zz or 327zz."""
    epsg = col(epsg)
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - ((epsg % 100) * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    y = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    return _EAST + _SCALE * _RADIUS * x, F.when(epsg >= 32700, _SOUTH).otherwise(0.0) + _SCALE * _RADIUS * y


def utm_inverse(x, y, epsg) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    epsg = col(epsg)
    xi = (col(y) - F.when(epsg >= 32700, _SOUTH).otherwise(0.0)) / (_SCALE * _RADIUS)
    eta = (col(x) - _EAST) / (_SCALE * _RADIUS)
    u = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    v = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA))
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(v), F.cos(u))) + ((epsg % 100) * 6 - 183)


#: Rings of up to so many edges stand in the plan edge by edge; larger ones are an array that is folded for each row.
FEW_EDGES = 64


def _crossing(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Whether a ray to the east crosses an edge, and whether the point lies on it."""
    at = (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1
    crosses = F.coalesce(((y1 > y) != (y2 > y)) & (x < at), F.lit(False))
    on = ((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    return crosses, on


def in_polygon(x, y, rings: list[list[tuple[float, float]]]) -> Column:
    """Strictly inside closed rings (lon, lat) by crossing parity, so holes count; a point on an edge is outside."""
    x, y = col(x), col(y)
    edges = [(float(x1), float(y1), float(x2), float(y2)) for ring in rings for (x1, y1), (x2, y2) in pairwise(ring)]
    if len(edges) > FEW_EDGES:
        table = F.from_json(F.lit(json.dumps(edges)), "array<array<double>>")  # a constant, parsed once
        start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))

        def step(s: Column, e: Column) -> Column:
            c, on = _crossing(x, y, e[0], e[1], e[2], e[3])
            return F.struct((s["odd"] != c).alias("odd"), (s["on"] | on).alias("on"))

        return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(table, start, step, lambda s: s["odd"] & ~s["on"]))
    crossings, on_edge = F.lit(0), F.lit(False)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return (crossings % 2 == 1) & ~on_edge


def box_ring(west: float, south: float, east: float, north: float) -> list[tuple[float, float]]:
    return [(west, south), (east, south), (east, north), (west, north), (west, south)]


def ring_area(ring: list[tuple[float, float]]) -> float:
    """Signed: positive if counter-clockwise."""
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in pairwise(ring)) / 2


def joined_ints(c) -> Column:
    """An aggregate: the distinct numbers in order, as text with commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(col(c))), lambda v: v.cast("string")), ",")
