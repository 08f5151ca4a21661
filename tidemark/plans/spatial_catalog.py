"""Queries of the spatial covers, the exact selection and the rasters, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import search, selection, spatial
from tidemark.plans.catalog import GEO, ITEMS, KM, items, r6, rounded, stations, table
from tidemark.plans.folders import local_folder, shared_folder
from tidemark.plans.partitions import PartitionTable
from tidemark.sources import rasters, requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _star(n: int, *radii: float) -> list[tuple[float, float]]:
    p = [(round(radii[i % len(radii)] * math.cos(2 * math.pi * i / n), 4), round(radii[i % len(radii)] * math.sin(2 * math.pi * i / n), 4)) for i in range(n)]
    return [*p, p[0]]


#: A star around each nation, and a hole in those of even key.
STAR, HOLE = _star(64, 0.21, 0.13, 0.17), _star(12, 0.04)


def _nation_polygons(spark, sf):
    around = lambda ring: F.array(*(F.struct((F.col("s_lon") + F.lit(x)).alias("lon"), (F.col("s_lat") + F.lit(y)).alias("lat")) for x, y in ring))
    return stations(spark, sf).select("station_id", F.when(F.col("station_id") % 2 == 0, F.array(around(STAR), around(HOLE))).otherwise(F.array(around(STAR))).alias("rings"))


_RINGS = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, r in ((1, STAR), (2, HOLE)) for a, b in zip(r[:-1], r[1:], strict=True))


@query(f"""WITH s AS (SELECT n_nationkey AS station_id, 46.7::DOUBLE + n_nationkey * 0.048::DOUBLE AS s_lat, 33.3::DOUBLE + n_nationkey * 0.084::DOUBLE AS s_lon FROM nation),
e AS (SELECT station_id, s_lon + ax AS x1, s_lat + ay AS y1, s_lon + bx AS x2, s_lat + by_ AS y2 FROM s CROSS JOIN (VALUES {_RINGS}) v(k, ax, ay, bx, by_) WHERE k = 1 OR station_id % 2 = 0),
b AS (SELECT station_id, min(x1) AS w, max(x1) AS ea, min(y1) AS so, max(y1) AS no FROM e GROUP BY 1),
p AS (SELECT lat, lon, count(*) AS n, sum(l_quantity) AS q FROM (SELECT l_quantity, {GEO} FROM lineitem) GROUP BY 1, 2),
i AS (SELECT b.station_id, lat, lon, any_value(n) AS n, any_value(q) AS q, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y1 <> y2 THEN y2 - y1 END) + x1 THEN 1 ELSE 0 END) % 2 = 1
      AND NOT bool_or((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside
      FROM p JOIN b ON lon BETWEEN w AND ea AND lat BETWEEN so AND no JOIN e ON e.station_id = b.station_id GROUP BY 1, 2, 3)
SELECT station_id::INT AS station_id, sum(n)::BIGINT AS points, round(sum(q)::DOUBLE, 2) AS quantity FROM i WHERE inside GROUP BY 1""")
def polygon_join(spark, sf):
    cover = spatial.polygon_cover(spatial.edges_of(_nation_polygons(spark, sf), "station_id"))
    found = spatial.polygon_join(items(spark, sf).select("lat", "lon", "l_quantity"), cover, out="station_id")
    return found.groupBy(F.col("station_id").cast("int").alias("station_id")).agg(F.count("*").alias("points"), F.round(F.sum("l_quantity").cast("double"), 2).alias("quantity"))


#: Customers and orders as places.
_CUSTOMERS = "SELECT c_custkey, 46.7::DOUBLE + (c_custkey * 7919 % 12011) / 10000.0::DOUBLE AS s_lat, 33.3::DOUBLE + (c_custkey * 104729 % 21011) / 10000.0::DOUBLE AS s_lon FROM customer"
_ORDERS = "SELECT o_orderkey, 46.7::DOUBLE + (o_custkey * 31 % 12011) / 10000.0::DOUBLE AS lat, 33.3::DOUBLE + (o_orderkey * 17 % 21011) / 10000.0::DOUBLE AS lon FROM orders"


def _places(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.lit(46.7) + (F.col("c_custkey").cast("long") * 7919 % 12011) / F.lit(10000.0)).alias("s_lat"), (F.lit(33.3) + (F.col("c_custkey").cast("long") * 104729 % 21011) / F.lit(10000.0)).alias("s_lon"))
    o = table(spark, sf, "orders").select("o_orderkey", (F.lit(46.7) + (F.col("o_custkey").cast("long") * 31 % 12011) / F.lit(10000.0)).alias("lat"), (F.lit(33.3) + (F.col("o_orderkey").cast("long") * 17 % 21011) / F.lit(10000.0)).alias("lon"))
    return c, o


@query(f"""WITH d AS (SELECT o_orderkey, min({{'km': {KM('lat', 'lon', 's_lat', 's_lon')}, 'c': c_custkey}}) AS m FROM ({_ORDERS}) CROSS JOIN ({_CUSTOMERS}) GROUP BY 1)
SELECT o_orderkey, m.c AS c_custkey, round(m.km, 6) AS km FROM d""")
def nearest_any(spark, sf):
    c, o = _places(spark, sf)
    return spatial.nearest_any(o, c, order=["c_custkey"]).select("o_orderkey", "c_custkey", r6("distance_km", "km"))


@query(f"""WITH d AS (SELECT o_orderkey, c_custkey, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM ({_ORDERS}) CROSS JOIN ({_CUSTOMERS})),
t AS (SELECT o_orderkey, unnest(min({{'km': km, 'c': c_custkey}}, 4)) AS m FROM d GROUP BY 1)
SELECT o_orderkey, round(coalesce(avg(m.c % 100) FILTER (m.km <= 1e-9), sum((m.c % 100) * pow(m.km, -2)) / sum(pow(m.km, -2))), 6) AS value, round(max(m.km), 6) AS reach_km FROM t GROUP BY 1""")
def idw_nearest(spark, sf):
    """Inverse distance weights over the four nearest of any number of controls."""
    c, o = _places(spark, sf)
    found = spatial.idw(o, c.withColumn("v", F.col("c_custkey") % 100), "v", k=4, order=["c_custkey"])
    return found.select("o_orderkey", r6("value"), r6("value_reach_km", "reach_km"))


_SPREAD = """count(h) AS n_points, round(median(h), 9) AS median, round(avg(h), 9) AS mean, round(stddev_samp(h), 6) AS std, round(median(dev), 9) AS mad,
  round(1.4826 * median(dev), 6) AS nmad, round(quantile_cont(h, 0.05), 9) AS p05, round(quantile_cont(h, 0.95), 9) AS p95"""


@query(f"""WITH p AS (SELECT * FROM ({ITEMS}) WHERE h IS NOT NULL),
a AS (SELECT *, abs(h - median(h) OVER (PARTITION BY l_linestatus, l_returnflag)) AS dev FROM p), b AS (SELECT *, abs(h - median(h) OVER (PARTITION BY l_linestatus)) AS dev FROM p)
SELECT l_linestatus, l_returnflag, false AS is_total, {_SPREAD} FROM a GROUP BY 1, 2 UNION ALL SELECT l_linestatus, 'ALL', true, {_SPREAD} FROM b GROUP BY 1""")
def hot_group_stats(spark, sf):
    """Groups and totals of a few large groups, no task of which holds a group."""
    out = selection.robust_stats_with_total(items(spark, sf), ["l_linestatus"], "l_returnflag", "height_m", hot_rows=2000)
    return out.withColumns({c: F.round(c, 9) for c in ("p05", "p95", "median", "mean", "mad")}).withColumns({c: F.round(c, 6) for c in ("std", "nmad")})


_PIXELS = "SELECT (l_partkey % 600)::INT AS row, (l_orderkey % 640)::INT AS col, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _pixels(spark, sf, level):
    """Line items counted by pixel, written as GeoTIFF and read back."""
    cells = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 600).cast("int").alias("row"), (F.col("l_orderkey") % 640).cast("int").alias("col")).agg(F.count("*").cast("double").alias("n"))
    path = local_folder(spark)
    rasters.write_geotiff(cells, path, rasters.Frame(33.0, 48.0, 0.001, 0.001, 600, 640, 4326), ["n"], block=64, file_blocks=8)
    return rasters.read_geotiff(spark, path, band=1, level=level)


@query(f"SELECT row, col, round(48.0::DOUBLE - (row + 0.5) * 0.001::DOUBLE, 6) AS lat, round(33.0::DOUBLE + (col + 0.5) * 0.001::DOUBLE, 6) AS lon, n::DOUBLE AS value FROM ({_PIXELS}) WHERE row BETWEEN 100 AND 400 AND col >= 300")
def raster_window(spark, sf):
    px = _pixels(spark, sf, 0).where("row between 100 and 400 and col >= 300 and value is not null")
    return px.select("row", "col", r6("lat"), r6("lon"), "value")


@query(f"SELECT round(48.0::DOUBLE - ((row // 4) + 0.5) * 0.004::DOUBLE, 6) AS lat, round(33.0::DOUBLE + ((col // 4) + 0.5) * 0.004::DOUBLE, 6) AS lon, round(avg(n), 5) AS value FROM ({_PIXELS}) GROUP BY 1, 2")
def raster_overview(spark, sf):
    return rounded(_pixels(spark, sf, 2).where("value is not null").select(r6("lat"), r6("lon"), F.round("value", 5).alias("value")))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 4 = 0 AND year(o_orderdate) = 1995 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders
WHERE o_orderkey % 3 <> 0 OR (o_orderkey % 4 = 0 AND year(o_orderdate) = 1995)""")
def partition_merge(spark, sf):
    """A table by year, and a batch of one year merged into it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    t = PartitionTable(spark, shared_folder(spark), ["o_orderkey", "o_orderdate"], {"year": F.year("o_orderdate")})
    t.merge(o.where("o_orderkey % 3 <> 0"))
    t.merge(o.where("o_orderkey % 4 = 0 and year(o_orderdate) = 1995").withColumn("o_orderstatus", F.lit("new")))
    return t.read().select("o_orderkey", "year", "o_orderstatus")


_SEEN = """SELECT event_id, (event_id * 37 % 3500) / 10.0::DOUBLE - 180 AS west, (event_id * 11 % 1700) / 10.0::DOUBLE - 90 AS south, (event_id * 37 % 3500) / 10.0::DOUBLE - 180 + (event_id % 7) AS east, (event_id * 11 % 1700) / 10.0::DOUBLE - 90 + (event_id % 5) AS north,
  ts::TIMESTAMP AS a, ts::TIMESTAMP + to_minutes((event_id % 600)::INT) AS b FROM events"""
_ASKED = """SELECT n_nationkey, -170 + n_nationkey * 12.5::DOUBLE AS west, -80 + n_nationkey * 5.5::DOUBLE AS south, -170 + n_nationkey * 12.5::DOUBLE + 25 AS east, -80 + n_nationkey * 5.5::DOUBLE + 20 AS north,
  lo + to_hours((n_nationkey * 5)::INT) AS a, lo + to_hours((n_nationkey * 5 + 200)::INT) AS b FROM nation, (SELECT min(ts)::TIMESTAMP AS lo FROM events)"""


@query(f"""SELECT n_nationkey, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM ({_SEEN}) g JOIN ({_ASKED}) q
ON g.west <= CASE WHEN q.east > 180 THEN 180 ELSE q.east END AND q.west <= g.east AND g.south <= q.north AND q.south <= g.north AND g.a <= q.b AND q.a <= g.b GROUP BY 1""")
def granule_search(spark, sf):
    """Events as granules with boxes and intervals, nations as areas with periods."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    west, south = (F.col("event_id") * 37 % 3500) / F.lit(10.0) - 180, (F.col("event_id") * 11 % 1700) / F.lit(10.0) - 90
    g = e.select("event_id", west.alias("west"), south.alias("south"), (west + F.col("event_id") % 7).alias("east"), (south + F.col("event_id") % 5).alias("north"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 600).cast("int"))).alias("end"))
    k, lo = F.col("n_nationkey"), F.col("lo")
    west, south = F.lit(-170) + k * F.lit(12.5), F.lit(-80) + k * F.lit(5.5)
    q = table(spark, sf, "nation").crossJoin(F.broadcast(e.agg(F.min("ts").alias("lo"))))  # one row
    q = q.select(k, west.alias("west"), south.alias("south"), F.least(F.lit(180.0), west + 25).alias("east"), (south + 20).alias("north"), (lo + F.make_dt_interval(hours=(k * 5).cast("int"))).alias("start"), (lo + F.make_dt_interval(hours=(k * 5 + 200).cast("int"))).alias("end"))
    found = search.search(g, q)
    return found.groupBy(F.col("area.n_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.min("granule.event_id").alias("first"), F.max("granule.event_id").alias("last"))


@query("""SELECT o_orderkey::VARCHAR AS granule, o_orderdate AS acquired, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey::VARCHAR) - 1) // 50)::INT AS batch FROM orders WHERE o_orderstatus <> 'F'""")
def all_request_batches(spark, sf):
    """All granules that are not done, dealt into requests in order of time, numbered without one task that sees them all."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("granule"), F.col("o_orderdate").alias("acquired"), "o_orderstatus")
    done = o.select("granule", F.when(F.col("o_orderstatus") == "F", "loaded").otherwise("pending").alias("status"))
    return requests.request_batches(o.drop("o_orderstatus"), done, requests.product("atl13"))
