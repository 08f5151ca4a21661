"""All queries over the driver's tables, and their SQL. Places are made from keys: items lie around, nations are stations."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import grids, joins, matchups, models, robust, selection, spatial
from tidemark.plans import store
from tidemark.sources import readers
from tidemark.streaming.ingest import sessions, window_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(X.col(c), 6).alias(name or c)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(r6(c) if c in names else F.col(c) for c in df.columns))


LAST, FIRST = "1995-06-17", "1997-01-01"
GEO = "46.7::DOUBLE + (l_partkey % 1201) / 1000.0::DOUBLE AS lat, 33.3::DOUBLE + (l_orderkey % 2101) / 1000.0::DOUBLE AS lon"
STATIONS = "SELECT n_nationkey AS station_id, n_name, 46.7::DOUBLE + n_nationkey * 0.048::DOUBLE AS s_lat, 33.3::DOUBLE + n_nationkey * 0.084::DOUBLE AS s_lon FROM nation"
KM = lambda a, b, c, d: f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"
PERIOD = lambda d: f"CASE WHEN {d}::DATE <= DATE '{LAST}' THEN 'PRE_BREACH' WHEN {d}::DATE < DATE '{FIRST}' THEN 'BREACH_DRAWDOWN' ELSE 'POST_BREACH' END"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as points."""
    d = table(spark, sf, "lineitem")
    return d.withColumns({
        "lat": F.lit(46.7) + (F.col("l_partkey") % 1201) / F.lit(1000.0), "lon": F.lit(33.3) + (F.col("l_orderkey") % 2101) / F.lit(1000.0),
        "height_m": F.when(F.col("l_quantity") != 3, F.col("l_extendedprice") / 1000), "stdev": F.col("l_tax"), "time": F.col("l_shipdate"),
        "on_water": F.when(F.col("l_quantity") != 2, F.col("l_quantity") != 1), "period": X.period_label("l_shipdate", LAST, FIRST),
    })


def stations(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("station_id"), "n_name", (F.lit(46.7) + F.col("n_nationkey") * F.lit(0.048)).alias("s_lat"), (F.lit(33.3) + F.col("n_nationkey") * F.lit(0.084)).alias("s_lon"))


ITEMS = f"""SELECT *, {GEO}, CASE WHEN l_quantity <> 3 THEN l_extendedprice / 1000 END AS h,
  CASE WHEN l_quantity <> 2 THEN l_quantity <> 1 END AS on_water, {PERIOD('l_shipdate')} AS period FROM lineitem"""


@query(f"""
WITH p AS (SELECT * FROM ({ITEMS}) WHERE coalesce(on_water, false)),
w AS (SELECT *, median(h) OVER (PARTITION BY l_suppkey, l_returnflag) AS med,
        min(CASE WHEN h IS NOT NULL THEN {{'y': lat, 'x': lon}} END) OVER (PARTITION BY l_suppkey, l_returnflag) AS a FROM p),
d AS (SELECT *, abs(h - med) AS dev, CASE WHEN h IS NOT NULL THEN {KM('a.y', 'a.x', 'lat', 'lon')} END AS dist FROM w),
m AS (SELECT l_suppkey, l_returnflag, period FROM (SELECT l_suppkey, l_returnflag, period, count(*) AS c FROM p GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY c DESC, period) = 1),
g AS (SELECT l_suppkey, l_returnflag, min(l_shipdate) AS datetime, count(h) AS n_points, median(h) AS median, avg(h) AS mean, stddev_samp(h) AS std,
        median(dev) AS mad, 1.4826 * median(dev) AS nmad, quantile_cont(h, 0.05) AS p05, quantile_cont(h, 0.95) AS p95, avg(l_tax) AS mean_noise,
        avg(lat) AS lat_mean, avg(lon) AS lon_mean,
        arg_max(dist, CASE WHEN dist IS NOT NULL THEN {{'y': lat, 'x': lon}} END) AS len, regr_slope(h, dist) AS sl, count(dist) AS nd
      FROM d GROUP BY 1, 2 HAVING count(h) > 0),
f AS (SELECT g.*, m.period, p95 - p05 AS range_m, CASE WHEN nd >= 3 AND len > 0 THEN sl END AS slope FROM g JOIN m USING (l_suppkey, l_returnflag))
SELECT l_suppkey, l_returnflag, datetime, n_points, round(median, 9) AS median, round(mean, 9) AS mean, round(std, 6) AS std, round(mad, 9) AS mad,
  round(nmad, 6) AS nmad, round(p05, 9) AS p05, round(p95, 9) AS p95, round(range_m, 9) AS range_m, round(mean_noise, 9) AS mean_noise, round(lat_mean, 9) AS lat_mean,
  round(lon_mean, 9) AS lon_mean, period, round(len, 6) AS track_length_km, round(slope, 6) AS slope_m_per_km,
  concat_ws('|', CASE WHEN n_points < 20 THEN 'too_few_points' END, CASE WHEN mad > 0.25 THEN 'mad' END, CASE WHEN range_m > 1.0 THEN 'range' END,
    CASE WHEN coalesce(len < 2.0, false) THEN 'track_too_short' END, CASE WHEN mean_noise > 0.5 THEN 'stdev' END,
    CASE WHEN NOT coalesce(len < 2.0, false) AND abs(slope) > 0.05 THEN 'slope' END) AS qc_flags
FROM f""")
def pass_levels(spark, sf):
    out = robust.pass_levels(items(spark, sf), keys=("l_suppkey", "l_returnflag"))
    out = out.withColumns({c: F.round(c, 9) for c in ("p05", "p95", "range_m", "median", "mean", "mad", "mean_noise", "lat_mean", "lon_mean")})
    return rounded(out.drop("qc_pass"), "std", "nmad", "track_length_km", "slope_m_per_km")


@query(f"""
WITH p AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM ({ITEMS}) WHERE h IS NOT NULL AND lon > 33.4 AND lon < 35.0 AND lat > 46.8 AND lat < 47.6),
w AS (SELECT *, abs(h - median(h) OVER (PARTITION BY month, l_returnflag)) AS dev FROM p)
SELECT month, l_returnflag, min(l_shipdate) AS datetime, count(*) AS n_points, round(median(h), 9) AS median, round(avg(h), 9) AS mean, round(median(dev), 9) AS mad,
  round(1.4826 * median(dev), 6) AS nmad, round(quantile_cont(h, 0.05), 9) AS p05, round(quantile_cont(h, 0.95), 9) AS p95,
  round(avg(lat), 9) AS lat_mean, round(avg(lon), 9) AS lon_mean, arg_min(period, {{'a': l_shipdate, 'b': lat, 'c': lon}}) AS period
FROM w GROUP BY 1, 2""")
def basic_pass_levels(spark, sf):
    d = items(spark, sf).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    inside = X.in_polygon("lon", "lat", [X.box_ring(33.4, 46.8, 35.0, 47.6)])
    out = robust.basic_pass_levels(d, inside, keys=("month", "l_returnflag")).withColumns({c: F.round(c, 9) for c in ("p05", "p95", "median", "mean", "mad", "lat_mean", "lon_mean")})
    return rounded(out, "nmad")


@query(f"""
WITH p AS (SELECT l_suppkey, lat, lon, h FROM ({ITEMS}) WHERE h IS NOT NULL),
w AS (SELECT *, min({{'y': lat, 'x': lon}}) OVER (PARTITION BY l_suppkey) AS a FROM p),
d AS (SELECT *, {KM('a.y', 'a.x', 'lat', 'lon')} AS dist FROM w)
SELECT l_suppkey, round(arg_max(dist, {{'y': lat, 'x': lon}}), 6) AS length_km,
  round(CASE WHEN count(*) >= 3 AND arg_max(dist, {{'y': lat, 'x': lon}}) > 0 THEN regr_slope(h, dist) END, 6) AS slope_m_per_km FROM d GROUP BY 1""")
def along_track_slope(spark, sf):
    return rounded(robust.track_slope(items(spark, sf), ["l_suppkey"], "lat", "lon", "height_m"), "length_km", "slope_m_per_km")


@query(f"SELECT {PERIOD('o_orderdate')} AS period, count(*) AS n FROM orders GROUP BY 1")
def period_label_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(X.period_label("o_orderdate", LAST, FIRST).alias("period")).agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, avg(l_tax) AS t, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
f AS (SELECT concat_ws('|', CASE WHEN n < 190 THEN 'few' END, CASE WHEN t > 0.04 THEN 'tax' END, CASE WHEN s > 23000 THEN 'spread' END) AS flags FROM g)
SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM f WHERE flags <> '') GROUP BY 1""")
def qc_flag_explode(spark, sf):
    tax = F.col("l_tax").try_cast("decimal(38,18)")  # added exactly: a mean of 0.04 is not above 0.04, in whatever order its rows come
    exact = F.when(F.count(tax) == F.count("l_tax"), F.try_sum(tax))  # null where a tax is no such number, as NaN
    above = F.coalesce(exact > F.lit(Decimal("0.04")) * F.count("l_tax"), F.avg("l_tax") > 0.04)
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), above.alias("t"), F.stddev_samp("l_extendedprice").alias("s"))
    flags = F.concat_ws("|", F.when(F.col("n") < 190, "few"), F.when(F.col("t"), "tax"), F.when(F.col("s") > 23000, "spread"))
    return robust.flag_counts(g.select(flags.alias("qc_flags")))


_ASOF = """
WITH v AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
e AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM v GROUP BY 1),
b AS (SELECT p.*, v.ts AS bt, v.value AS bv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
a AS (SELECT b.*, v.ts AS ft, v.value AS fv FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts < v.ts),
s AS (SELECT a.*, t0, t1, (epoch_us(ts) - epoch_us(bt)) / 1e6 AS gb, (epoch_us(ft) - epoch_us(ts)) / 1e6 AS gf FROM a LEFT JOIN e USING (user_id)),
g AS (SELECT *, least(gb, gf) / 3600 AS gap, CASE WHEN bt IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN bv ELSE fv END AS nearest,
        bv + (fv - bv) * gb / (gb + gf) AS line, coalesce(ts > t0 AND ts < t1, false) AS inner_ FROM s)
"""


def _views(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'")


@query(_ASOF + "SELECT event_id, round(nearest, 6) AS value, round(gap, 6) AS gap_hours FROM g")
def asof_nearest(spark, sf):
    p, v = _views(spark, sf)
    return joins.asof(p, v, key="user_id", method="nearest", max_gap_hours=None).select("event_id", r6("value"), r6("gap_hours"))


@query(_ASOF + "SELECT event_id, round(CASE WHEN inner_ THEN line ELSE nearest END, 6) AS value, inner_ AND gap IS NOT NULL AS interpolated FROM g")
def asof_linear(spark, sf):
    p, v = _views(spark, sf)
    return joins.asof(p, v, key="user_id", max_gap_hours=None).select("event_id", r6("value"), "interpolated")


@query(_ASOF + "SELECT event_id, round(CASE WHEN gap <= 12 THEN CASE WHEN inner_ THEN line ELSE nearest END END, 6) AS value, coalesce(gap <= 12, false) AND inner_ AS interpolated, round(gap, 6) AS gap_hours FROM g")
def asof_gap(spark, sf):
    p, v = _views(spark, sf)
    return joins.asof(p, v, key="user_id", max_gap_hours=12).select("event_id", r6("value"), "interpolated", r6("gap_hours"))


@query(_ASOF.replace("SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2").replace("SELECT event_id, user_id, ts FROM events", "SELECT event_id, user_id, date_trunc('day', ts)::TIMESTAMP AS ts FROM events")
       + "SELECT event_id, round(CASE WHEN ts BETWEEN t0 AND t1 THEN CASE WHEN ft IS NULL OR gb = 0 THEN nearest ELSE line END END, 6) AS value FROM g")
def interp_no_extrapolation(spark, sf):
    p, v = _views(spark, sf)
    day = lambda d: d.withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    series = day(v).groupBy("user_id", "ts").agg(F.avg("value").alias("value"))
    return joins.asof(day(p), series, key="user_id", max_gap_hours=None, ends="null").select("event_id", r6("value"))


_LEVELS = "SELECT o_orderdate::DATE AS date, o_orderpriority, median(o_totalprice) AS median, count(*) >= 5 AS qc_pass FROM orders GROUP BY 1, 2"


def _order_levels(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date"), "o_orderpriority").agg(F.median("o_totalprice").alias("median"), (F.count("*") >= 5).alias("qc_pass"))


@query(f"SELECT date, round(median(median), 6) AS reservoir_level FROM ({_LEVELS}) WHERE qc_pass GROUP BY 1")
def daily_reservoir_level(spark, sf):
    return rounded(robust.level_by_date(_order_levels(spark, sf)), "reservoir_level")


@query("""WITH p AS (SELECT DISTINCT o_orderdate::DATE AS date, (o_custkey % 7)::INT AS rgt, (o_custkey % 3)::VARCHAR AS beam FROM orders),
r AS (SELECT date, rgt, beam, bool_and(o_orderstatus = 'F') AS ok FROM (SELECT *, o_orderdate::DATE AS date, (o_custkey % 7)::INT AS rgt, (o_custkey % 3)::VARCHAR AS beam FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2, 3)
SELECT p.*, ok AS reservoir_qc_pass FROM p LEFT JOIN r USING (date, rgt, beam)""")
def left_join_reservoir_qc(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 7).cast("int").alias("rgt"), (F.col("o_custkey") % 3).cast("string").alias("beam"), "o_orderstatus")
    r = o.where("o_orderstatus <> 'P'").groupBy("date", "rgt", "beam").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("qc_pass"))
    return matchups.with_reservoir_qc(o.drop("o_orderstatus").distinct(), r)


@query("""WITH f AS (SELECT o_custkey, o_orderkey AS first_order, o_orderdate AS first_date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_custkey, first_order, first_date FROM customer LEFT JOIN f ON nullif(c_custkey % 7, 0) IS NOT NULL AND o_custkey = c_custkey""")
def granule_lookup_first(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("o_custkey"))
    o = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "first_order", "o_orderdate": "first_date"})
    return joins.lookup_first(c, o, ["o_custkey"], ["first_date", "first_order"], ["first_order", "first_date"]).drop("o_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('F', 'O'))")
def anti_join_done(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return joins.not_done(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey", ("F", "O"))


@query("""WITH s AS (SELECT o_orderdate::DATE AS date FROM orders GROUP BY 1 HAVING count(*) > 1 AND max(o_totalprice) - min(o_totalprice) > 400000)
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::DATE IN (SELECT date FROM s)""")
def semi_join_disagree(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return robust.disagreeing(o, ["date"], "o_totalprice", 400000).select("o_orderkey", "o_totalprice")


@query(f"""SELECT station_id, count(*) AS n, round(avg(km), 6) AS mean_km, round(min(km), 6) AS min_km FROM (
  SELECT station_id, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM (SELECT {GEO} FROM lineitem) CROSS JOIN ({STATIONS})) WHERE km <= 10 GROUP BY 1""")
def radius_join(spark, sf):
    out = joins.radius_join(items(spark, sf).select("lat", "lon"), stations(spark, sf), 10.0)
    return out.groupBy("station_id").agg(F.count("*").alias("n"), r6(F.avg("distance_km"), "mean_km"), r6(F.min("distance_km"), "min_km"))


RADII = (0.05, 1.0, 2.0, 5.0)


@query(f"""WITH near AS (SELECT station_id, l_suppkey % 17 AS rgt, l_shipdate::DATE AS date, l_extendedprice / 1000 - 30 AS c, {KM('lat', 'lon', 's_lat', 's_lon')} AS km
    FROM (SELECT *, {GEO} FROM lineitem) CROSS JOIN ({STATIONS})),
r AS (SELECT unnest([0.05, 1.0, 2.0, 5.0]::DOUBLE[]) AS radius_km), x AS (SELECT n.*, radius_km FROM near n JOIN r ON km <= radius_km),
w AS (SELECT *, abs(c - median(c) OVER (PARTITION BY station_id, radius_km)) AS dev FROM x),
s AS (SELECT station_id, radius_km, count(*) AS n, count(DISTINCT date) AS n_dates, count(DISTINCT rgt) AS n_rgts,
      array_to_string(list_sort(list(DISTINCT rgt)), ',') AS rgts, median(c) AS median, 1.4826 * median(dev) AS nmad, stddev_samp(c) AS std FROM w GROUP BY 1, 2)
SELECT q.station_id, r.radius_km, coalesce(n, 0) AS n, coalesce(n_dates, 0) AS n_dates, coalesce(n_rgts, 0) AS n_rgts, rgts, round(median, 6) AS median, round(nmad, 6) AS nmad, round(std, 6) AS std,
  round(median - CASE WHEN n > 1 THEN 1.96 * 1.2533 * nmad / sqrt(n) END, 6) AS ci_low, round(median + CASE WHEN n > 1 THEN 1.96 * 1.2533 * nmad / sqrt(n) END, 6) AS ci_high, coalesce(n < 5, true) AS indicative
FROM ({STATIONS}) q CROSS JOIN r LEFT JOIN s USING (station_id, radius_km)""")
def radius_ladder(spark, sf):
    p = items(spark, sf).select("lat", "lon", (F.col("l_suppkey") % 17).alias("rgt"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / 1000 - 30).alias("c"))
    near = joins.radius_join(p, stations(spark, sf), max(RADII)).withColumn("radius_km", F.explode(F.filter(F.array(*(F.lit(r) for r in RADII)), lambda r: F.col("distance_km") <= r)))
    return rounded(matchups.radius_ladder(near, stations(spark, sf), list(RADII)), "median", "nmad", "std", "ci_low", "ci_high")


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, {GEO} FROM lineitem),
d AS (SELECT p.*, n_name, station_id, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM p CROSS JOIN (SELECT * FROM ({STATIONS}) WHERE station_id % 5 <> 4))
SELECT l_orderkey, l_linenumber, lat, n_name AS station, round(km, 6) AS station_km, round(station_id * 0.01::DOUBLE + l_linenumber, 6) AS level FROM d
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, lat, lon ORDER BY km, station_id) = 1""")
def nearest_station(spark, sf):
    near = sorted(stations(spark, sf).collect(), key=lambda r: r["station_id"])  # a dimension table of 25 rows
    known = [(r["n_name"], r["s_lat"], r["s_lon"], None if r["station_id"] % 5 == 4 else r["station_id"] * 0.01, 0.02) for r in near]
    p = items(spark, sf).select("l_orderkey", "l_linenumber", "lat", "lon", F.col("l_linenumber").cast("double").alias("h")).distinct()
    return joins.augmented(p, known, "h", "level").select("l_orderkey", "l_linenumber", "lat", "station", r6("station_km"), r6("level"))


RING = [(33.5, 46.8), (35.1, 46.9), (35.2, 47.7), (34.2, 47.2), (33.6, 47.8), (33.5, 46.8)]
HOLE = [(34.0, 46.95), (34.4, 46.95), (34.4, 47.1), (34.0, 47.1), (34.0, 46.95)]
_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for r in (RING, HOLE) for a, b in zip(r[:-1], r[1:], strict=True))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, {GEO} FROM lineitem), e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
i AS (SELECT p.l_orderkey, p.l_linenumber, p.l_returnflag, p.lat, p.lon, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AND
      NOT bool_or((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, lat, lon FROM p) p CROSS JOIN e GROUP BY ALL)
SELECT l_returnflag, inside, count(*) AS n FROM i GROUP BY 1, 2""")
def point_in_polygon(spark, sf):
    p = items(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "lat", "lon").distinct()
    return p.withColumn("inside", X.in_polygon("lon", "lat", [RING, HOLE])).groupBy("l_returnflag", "inside").agg(F.count("*").alias("n"))


AXIS = grids.Axis(46.6, 33.2, 0.05, 0.1, 30, 25)
_GRID = "SELECT iy, ix, 46.6::DOUBLE + iy * 0.05::DOUBLE AS lat, 33.2::DOUBLE + ix * 0.1::DOUBLE AS lon, CASE WHEN (iy * 7 + ix * 3) % 41 <> 5 AND iy > 0 AND ix < 24 THEN 10 + sin(iy / 3.0::DOUBLE) + cos(ix / 4.0::DOUBLE) END AS value FROM generate_series(0, 29) a(iy) CROSS JOIN generate_series(0, 24) b(ix)"


def _grid(spark):
    value = F.when(((F.col("iy") * 7 + F.col("ix") * 3) % 41 != 5) & (F.col("iy") > 0) & (F.col("ix") < 24), 10 + F.sin(F.col("iy") / 3.0) + F.cos(F.col("ix") / 4.0))
    return grids.lattice(spark, AXIS).withColumn("value", value)


_SAMPLE = f"""WITH g AS ({_GRID}), p AS (SELECT DISTINCT l_orderkey, {GEO} FROM lineitem),
f AS (SELECT *, (lat - 46.6::DOUBLE) / 0.05::DOUBLE AS fy, (lon - 33.2::DOUBLE) / 0.1::DOUBLE AS fx FROM p),"""


@query(_SAMPLE + """c AS (SELECT *, CASE WHEN fy BETWEEN 0 AND 29 AND fx BETWEEN 0 AND 24 THEN greatest(0, least(floor(fy), 28)) END AS jy, CASE WHEN fy BETWEEN 0 AND 29 AND fx BETWEEN 0 AND 24 THEN greatest(0, least(floor(fx), 23)) END AS jx FROM f)
SELECT l_orderkey, c.lat, round(a.value * (1 - (fy - jy)) * (1 - (fx - jx)) + b.value * (1 - (fy - jy)) * (fx - jx) + d.value * (fy - jy) * (1 - (fx - jx)) + e.value * (fy - jy) * (fx - jx), 6) AS zeta
FROM c LEFT JOIN g a ON a.iy = jy AND a.ix = jx LEFT JOIN g b ON b.iy = jy AND b.ix = jx + 1 LEFT JOIN g d ON d.iy = jy + 1 AND d.ix = jx LEFT JOIN g e ON e.iy = jy + 1 AND e.ix = jx + 1""")
def grid_bilinear(spark, sf):
    p = items(spark, sf).select("l_orderkey", "lat", "lon").distinct()
    return grids.sample_bilinear(p, _grid(spark), AXIS, "zeta").select("l_orderkey", "lat", r6("zeta"))


@query(_SAMPLE + "c AS (SELECT *, floor(fy + 0.5) AS jy, floor(fx + 0.5) AS jx FROM f) SELECT l_orderkey, c.lat, round(g.value, 6) AS dem FROM c LEFT JOIN g ON g.iy = jy AND g.ix = jx")
def grid_nearest(spark, sf):
    p = items(spark, sf).select("l_orderkey", "lat", "lon").distinct()
    return grids.sample_nearest(p, _grid(spark), AXIS, "dem").select("l_orderkey", "lat", r6("dem"))


#: A grid of the mean quantity of the line items at each node; nodes without any have no value.
_ITEM_GRID = "SELECT iy, ix, 46.6::DOUBLE + iy * 0.05::DOUBLE AS lat, 33.2::DOUBLE + ix * 0.1::DOUBLE AS lon, value FROM generate_series(0, 29) a(iy) CROSS JOIN generate_series(0, 24) b(ix) LEFT JOIN (SELECT l_partkey % 26 + 2 AS iy, l_suppkey % 17 + 4 AS ix, round(avg(l_quantity), 6)::DOUBLE AS value FROM lineitem WHERE (l_partkey * 7 + l_suppkey * 3) % 41 <> 5 GROUP BY 1, 2) USING (iy, ix)"


def _item_grid(spark, sf):
    v = table(spark, sf, "lineitem").where((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 41 != 5).groupBy((F.col("l_partkey") % 26 + 2).cast("int").alias("iy"), (F.col("l_suppkey") % 17 + 4).cast("int").alias("ix")).agg(F.round(F.avg("l_quantity").cast("double"), 6).alias("value"))
    return grids.lattice(spark, AXIS).join(v, ["iy", "ix"], "left")


@query(f"""WITH g AS ({_ITEM_GRID}), n AS (SELECT y AS iy, x AS ix, (46.6::DOUBLE + y * 0.08::DOUBLE - 46.6::DOUBLE) / 0.05::DOUBLE AS fy, (33.2::DOUBLE + x * 0.08::DOUBLE - 33.2::DOUBLE) / 0.1::DOUBLE AS fx FROM generate_series(0, 18) a(y) CROSS JOIN generate_series(0, 30) b(x)),
c AS (SELECT *, greatest(0, least(floor(fy), 28)) AS jy, greatest(0, least(floor(fx), 23)) AS jx FROM n)
SELECT c.iy::INT AS iy, c.ix::INT AS ix, round(a.value * (1 - (fy - jy)) * (1 - (fx - jx)) + b.value * (1 - (fy - jy)) * (fx - jx) + d.value * (fy - jy) * (1 - (fx - jx)) + e.value * (fy - jy) * (fx - jx), 5) AS value
FROM c LEFT JOIN g a ON a.iy = jy AND a.ix = jx LEFT JOIN g b ON b.iy = jy AND b.ix = jx + 1 LEFT JOIN g d ON d.iy = jy + 1 AND d.ix = jx LEFT JOIN g e ON e.iy = jy + 1 AND e.ix = jx + 1""")
def grid_resample(spark, sf):
    return grids.resample(_item_grid(spark, sf), AXIS, 0.08).select("iy", "ix", F.round("value", 5).alias("value"))


@query(f"""WITH g AS ({_ITEM_GRID}), b AS (SELECT min(iy) y0, max(iy) y1, min(ix) x0, max(ix) x1 FROM g WHERE value IS NOT NULL), t AS (SELECT g.* FROM g, b WHERE iy BETWEEN y0 AND y1 AND ix BETWEEN x0 AND x1)
SELECT count(*) AS nodes, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS std FROM t""")
def grid_trim_stats(spark, sf):
    t = grids.trim_to_valid(_item_grid(spark, sf))
    return rounded(t.agg(F.count("*").alias("nodes")).crossJoin(grids.grid_statistics(t)), "mean", "low", "high", "std")  # one row each


@query(f"""WITH p AS (SELECT (l_orderkey % 2101) * 40.0::DOUBLE AS x, (l_partkey % 1201) * 60.0::DOUBLE AS y, l_extendedprice AS v FROM lineitem),
b AS (SELECT floor(min(x) / 5000) * 5000 AS x0, CASE WHEN ceil(max(y) / 5000) * 5000 = max(y) THEN max(y) + 5000 ELSE ceil(max(y) / 5000) * 5000 END AS y1 FROM p)
SELECT floor((y1 - y) / 5000)::INT AS row, floor((x - x0) / 5000)::INT AS col, round(median(v), 6) AS value, count(*) AS n_points FROM p, b GROUP BY 1, 2""")
def grid_cells_median(spark, sf):
    p = table(spark, sf, "lineitem").select(((F.col("l_orderkey") % 2101) * F.lit(40.0)).alias("x"), ((F.col("l_partkey") % 1201) * F.lit(60.0)).alias("y"), F.col("l_extendedprice").alias("v"))
    return rounded(grids.grid_cells(p, "v", "x", "y", 5000.0).drop("x0", "y1"), "value")


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1), d AS (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - t END AS v FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
w AS (SELECT *, abs(v - median(v) OVER (PARTITION BY o_orderpriority)) AS dev FROM d)
SELECT o_orderpriority, count(v) AS n_points, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(1.4826 * median(dev), 4) AS nmad, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.95), 4) AS p95, round(sqrt(avg(v * v)), 4) AS rmse FROM w GROUP BY 1""")
def dem_compare(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("t"))
    d = table(spark, sf, "orders").join(s, "o_orderkey", "left")
    out = robust.compare_heights(d, ["o_orderpriority"], "o_totalprice", "t", F.col("o_orderstatus") != "P")
    return out.select("o_orderpriority", "n_points", *(F.round(c, 4).alias(c) for c in ("median", "mean", "std", "nmad", "p05", "p95", "rmse")))


_RES = "SELECT c_mktsegment, c_nationkey, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 1000 - c_nationkey / 5.0::DOUBLE END AS v FROM customer"


def _residuals(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 1000 - F.col("c_nationkey") / 5.0).alias("v"))


_STATS = "count(v) AS n, round(avg(v), 6) AS bias, round(avg(abs(v)), 6) AS mae, round(sqrt(avg(v * v)), 6) AS rmse, round(stddev_samp(v), 6) AS std, round(1.4826 * median(dev), 6) AS nmad, round(median(v), 6) AS median, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v)), 6) AS ci_low, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v)), 6) AS ci_high"


@query(f"SELECT c_mktsegment, {_STATS} FROM (SELECT *, abs(v - median(v) OVER (PARTITION BY c_mktsegment)) AS dev FROM ({_RES})) GROUP BY 1")
def residual_stats_by(spark, sf):
    out = robust.residual_stats(_residuals(spark, sf), ["c_mktsegment"], "v")
    return rounded(out, *out.columns[2:])


@query(f"""SELECT c_nationkey::VARCHAR AS station, false AS is_total, {_STATS} FROM (SELECT *, abs(v - median(v) OVER (PARTITION BY c_nationkey)) AS dev FROM ({_RES})) GROUP BY c_nationkey
UNION ALL SELECT 'ALL', true, {_STATS} FROM (SELECT *, abs(v - median(v) OVER ()) AS dev FROM ({_RES}))""")
def alignment_all_row(spark, sf):
    out = matchups.alignment(_residuals(spark, sf).withColumnRenamed("c_nationkey", "station_id"), "v").withColumnsRenamed({"value_mean": "bias", "value_median": "median"})
    return rounded(out, "bias", "mae", "rmse", "std", "nmad", "median", "ci_low", "ci_high")


@query("""WITH d AS (SELECT s_nationkey AS station_id, s_suppkey % 3 AS rgt, s_acctbal / 1000 AS v FROM supplier),
w AS (SELECT *, abs(v - median(v) OVER (PARTITION BY station_id, rgt)) AS dev, abs(v - median(v) OVER (PARTITION BY station_id)) AS dev_all FROM d),
g AS (SELECT station_id, rgt::VARCHAR AS rgt, false AS is_total, count(*) AS n, median(v) AS median, 1.4826 * median(dev) AS nmad FROM w GROUP BY 1, 2
  UNION ALL SELECT station_id, 'ALL', true, count(*), median(v), 1.4826 * median(dev_all) FROM w GROUP BY 1)
SELECT station_id, rgt, is_total, n, round(median, 6) AS median, round(nmad, 6) AS nmad, round(median - max(CASE WHEN is_total THEN median END) OVER (PARTITION BY station_id), 6) AS bias FROM g""")
def per_rgt_bias(spark, sf):
    d = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("station_id"), (F.col("s_suppkey") % 3).alias("rgt"), (F.col("s_acctbal") / 1000).alias("c"), F.lit(2.0).alias("radius_km"))
    return rounded(matchups.per_track(d, 2.0), "median", "nmad", "bias")


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1""")
def agreement_ols(spark, sf):
    out = robust.agreement(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", r6("slope"), F.round("intercept", 4).alias("intercept"), r6("r2"), r6("pearson"))


@query("""SELECT user_id AS station_id, ts::DATE AS date, event_type AS source, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, event_type, value) = 1""")
def source_priority_dedupe(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("source"), "value")
    return rounded(readers.stitched(e, ("purchase", "signup", "click", "view")), "value")


@query("""WITH m AS (SELECT day(o_orderdate) AS d, year(o_orderdate) AS y, month(o_orderdate) AS mo, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3)
SELECT make_date(y, mo, d) AS date, v AS value FROM m""")
def melt_grid(spark, sf):
    o = table(spark, sf, "orders").withColumns({"m": F.format_string("m%02d", F.month("o_orderdate")), "year": F.year("o_orderdate")})
    months = [f"m{i:02d}" for i in range(1, 13)]
    wide = o.groupBy("year", F.dayofmonth("o_orderdate").alias("day")).pivot("m", months).agg(F.round(F.sum("o_totalprice"), 2))
    return readers.yearbook_grid(wide, F.col("year"), months)


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS o, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS p FROM orders GROUP BY 1""")
def pivot_radius(spark, sf):
    out = robust.pivot_mean(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return out.select("o_orderpriority", *(F.round(c, 4).alias(c.lower()) for c in ("F", "O", "P")))


@query("""SELECT c_nationkey, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last, count(*) AS n, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS years, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources,
  bool_or(o_totalprice IS NOT NULL) AS any_value, min(o_totalprice) AS low, max(o_totalprice) AS high, max(CASE WHEN o_orderdate::DATE >= DATE '1997-01-01' THEN o_totalprice END) AS high_after FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def coverage_summary(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate")).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return robust.coverage(o, ["c_nationkey"], "date", "o_totalprice", "o_orderstatus", F.col("date") >= F.lit(FIRST).cast("date"))


@query("""SELECT CASE WHEN grouping(y) = 1 THEN 'ALL' ELSE y::VARCHAR END AS year, grouping(y) = 1 AS is_total, count(*) AS n, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((y), ())""")
def estuary_year_all(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    out = selection.quantiles_with_total(o, [], "year", "o_totalprice", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    return out.withColumns({c: F.round(c, 4) for c in ("median", "p05", "p95")})


@query("""WITH g AS (SELECT o_orderkey, 'gross' AS reason, 1 AS p FROM orders WHERE o_totalprice > 480000), s AS (SELECT o_orderdate::DATE AS d FROM orders GROUP BY 1 HAVING count(*) > 1 AND max(o_totalprice) - min(o_totalprice) > 450000),
u AS (SELECT * FROM g UNION ALL SELECT o_orderkey, 'beams', 2 FROM orders WHERE o_orderdate::DATE IN (SELECT d FROM s))
SELECT o_orderkey, reason FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p) = 1""")
def beam_agreement_outliers(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    gross = o.where("o_totalprice > 480000").select("o_orderkey", F.lit("gross").alias("reason"), F.lit(1).alias("p"))
    beams = robust.disagreeing(o, ["date"], "o_totalprice", 450000).select("o_orderkey", F.lit("beams").alias("reason"), F.lit(2).alias("p"))
    return joins.first_per_key(robust.union_all(gross, beams), ["o_orderkey"], ["p"]).drop("p")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def monthly_levels(spark, sf):
    out = robust.monthly(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("median", "std")})


_NAME = "CASE WHEN o_orderkey % 13 = 0 THEN 'broken_' || o_orderkey ELSE 'ATL13_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '_' || lpad((o_orderkey % 1387)::VARCHAR, 4, '0') || lpad((o_custkey % 27)::VARCHAR, 2, '0') || '01_007_0' || (o_orderkey % 3)::VARCHAR || '.h5' END"


@query(f"""WITH n AS (SELECT o_orderkey, {_NAME} AS granule FROM orders), p AS (SELECT *, regexp_extract(granule, '^(ATL\\d{{2}})_(\\d{{14}})_(\\d{{4}})(\\d{{2}})(\\d{{2}})_(\\d{{3}})_(\\d{{2}})\\.h5$', ['product', 't', 'rgt', 'cycle', 'region', 'release', 'version']) AS m FROM n)
SELECT o_orderkey, nullif(m.product, '') AS product, CASE WHEN m.t <> '' THEN strptime(m.t, '%Y%m%d%H%M%S') END AS acquired, try_cast(m.rgt AS INT) AS rgt, try_cast(m.cycle AS INT) AS cycle, nullif(m.release, '') AS release, nullif(m.version, '') AS version FROM p""")
def regexp_granule_parse(spark, sf):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.concat(F.lit("ATL13_"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("_"), pad(F.col("o_orderkey") % 1387, 4), pad(F.col("o_custkey") % 27, 2), F.lit("01_007_0"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".h5"))
    n = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("broken_"), F.col("o_orderkey").cast("string"))).otherwise(name).alias("granule"))
    return readers.parsed(n).select("o_orderkey", "product", F.col("acquired").cast("timestamp_ntz").alias("acquired"), "rgt", "cycle", "release", "version")


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
l AS (SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS status, min(ts) AS created_at, arg_max(k, {'a': ts, 'b': event_id}) FILTER (k IS NOT NULL) AS k, arg_max(value, {'a': ts, 'b': event_id}) FILTER (event_type = 'purchase') AS paid FROM e GROUP BY 1)
SELECT user_id AS job_id, status, created_at, k, round(paid, 6) AS paid FROM l""")
def json_stats_merge(spark, sf):
    e = table(spark, sf, "events")
    stats = F.map_filter(F.map_concat(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("paid"), F.when(F.col("event_type") == "purchase", F.col("value").cast("string")))), lambda _, v: v.isNotNull())
    log = e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("stage"), stats.alias("stats"))
    return store.latest_jobs(log).select("job_id", "status", "created_at", F.try_element_at("stats", F.lit("k")).alias("k"), F.round(F.try_element_at("stats", F.lit("paid")).cast("double"), 6).alias("paid"))


@query("""WITH l AS (SELECT user_id, string_agg(round(value, 3)::VARCHAR || ' ' || (event_id % 90)::DOUBLE::VARCHAR, ', ' ORDER BY ts, round(value, 3), event_id % 90) AS line, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1)
SELECT user_id, n, md5('LINESTRING(' || line || ')') AS line FROM l""")
def ordered_line(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.round("value", 3).alias("lon"), (F.col("event_id") % 90).cast("double").alias("lat"))
    return store.lines_of_passes(e, ["user_id"], time="ts").select("user_id", F.size("line").cast("bigint").alias("n"), F.md5("wkt").alias("line"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + 1 END AS o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def keyed_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").withColumns({"o_custkey": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") + 1), "o_totalprice": F.col("o_totalprice") * 2})
    return joins.merged(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], keep_old_if_null=("o_custkey",))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk_points(spark, sf):
    return store.filtered(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), order=[F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], limit=100)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_jobs_filter(spark, sf):
    return store.filtered(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), equal={"o_orderstatus": "F", "o_custkey": None}, day="o_orderdate", start="1995-01-01", end="1995-12-31", order=[F.desc("o_orderdate"), "o_orderkey"], limit=50).drop("o_orderstatus")


@query("""WITH e AS (SELECT event_type, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS c, greatest(-1, least(floor(value / 20), 10))::INT AS bin FROM events WHERE value IS NOT NULL)
SELECT event_type, bin, count(*) AS n, round(max(c), 6) AS ecdf FROM e GROUP BY 1, 2""")
def ecdf_hist(spark, sf):
    e = robust.empirical_cdf(table(spark, sf, "events").where("value is not null"), ["event_type"], "value")
    return e.groupBy("event_type", F.greatest(F.lit(-1), F.least(F.floor(F.col("value") / 20), F.lit(10))).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.max("ecdf"), "ecdf"))


_CONTROL = f"SELECT station_id, s_lat, s_lon, v FROM ({STATIONS}) JOIN (SELECT s_nationkey AS station_id, median(s_acctbal) / 1000 AS v FROM supplier GROUP BY 1) USING (station_id)"


def _controls(spark, sf):
    return stations(spark, sf).join(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("station_id")).agg((F.median("s_acctbal") / 1000).alias("v")), "station_id")


@query(f"SELECT round(median(v), 6) AS constant, 6::BIGINT AS n FROM ({_CONTROL})")
def model_constant(spark, sf):
    c = _controls(spark, sf).select(F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), F.col("v").alias("value"))
    out = models.fit_all(c, grids.lattice(spark, grids.Axis(47.0, 34.0, 0.5, 0.5, 3, 2)), models=("constant",))
    return out.groupBy(r6("value", "constant")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT l_returnflag, l_quantity AS x, l_discount AS y, l_extendedprice / 1000 AS v FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, avg(x) mx, avg(y) my, avg(v) mv, var_pop(x) * count(*) sxx, var_pop(y) * count(*) syy, covar_pop(x, y) * count(*) sxy, covar_pop(x, v) * count(*) sxv, covar_pop(y, v) * count(*) syv FROM q GROUP BY 1),
f AS (SELECT *, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS b, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS d FROM s)
SELECT l_returnflag, n, round(mv - b * mx - d * my, 5) AS a, round(b, 6) AS b, round(d, 5) AS d FROM f""")
def model_plane(spark, sf):
    q = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (F.col("l_extendedprice") / 1000).alias("v"))
    return models.plane_by_sums(q, ["l_returnflag"], "x", "y", "v").select("l_returnflag", "n", F.round("a", 5).alias("a"), r6("b"), F.round("d", 5).alias("d"))


@query(f"""WITH c AS ({_CONTROL}), p AS (SELECT DISTINCT l_partkey % 1201 AS i, 46.7::DOUBLE + (l_partkey % 1201) / 1000.0::DOUBLE AS lat, 34.0::DOUBLE AS lon FROM lineitem),
d AS (SELECT i, v, station_id, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM p CROSS JOIN c)
SELECT i, round(coalesce(avg(v) FILTER (km <= 1e-9), sum(v * pow(km, -2)) / sum(pow(km, -2))), 6) AS value FROM d GROUP BY 1""")
def model_idw(spark, sf):
    p = items(spark, sf).select((F.col("l_partkey") % 1201).alias("i"), "lat", F.lit(34.0).alias("lon")).distinct()
    return spatial.idw(p, _controls(spark, sf), "v", k=25, out="value").select("i", r6("value"))


@query()
def loso_cv(spark, sf):
    out = models.leave_one_out(_controls(spark, sf).select(F.col("n_name").alias("slug"), F.col("s_lat").alias("lat"), (F.col("s_lon") + (F.col("station_id") % 3) * 0.1).alias("lon"), F.col("v").alias("value")))
    return models.cv_summary(out)


@query()
def bootstrap_median_ci(spark, sf):
    return models.bootstrap_median(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"])


@query(f"""WITH u AS (SELECT 'ATL13' AS product, count(*) AS n FROM lineitem UNION ALL SELECT 'ATL08', count(*) FROM orders UNION ALL SELECT 'ATL03', count(*) FROM events) SELECT product, n FROM u""")
def counts_per_table(spark, sf):
    return robust.union_all(*(table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(p).alias("product"), "n") for p, t in (("ATL13", "lineitem"), ("ATL08", "orders"), ("ATL03", "events"))))


@query("""SELECT granule, concat_ws('+', CASE WHEN bool_or(s) THEN 'seed' END, CASE WHEN bool_or(c) THEN 'cmr' END) AS source FROM (
  SELECT 'ATL13_20200101000000_' || lpad((o_custkey % 900)::VARCHAR, 4, '0') || '0101_007_01.h5' AS granule, true AS s, false AS c FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'ATL13_20200101000000_' || lpad((o_custkey % 1000)::VARCHAR, 4, '0') || '0101_007_01.h5', false, true FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1""")
def manifest_sources(spark, sf):
    o = table(spark, sf, "orders")
    name = lambda m: F.concat(F.lit("ATL13_20200101000000_"), F.lpad((F.col("o_custkey") % m).cast("string"), 4, "0"), F.lit("0101_007_01.h5")).alias("granule")
    return readers.manifest(o.where("o_orderkey % 4 = 0").select(name(900)), o.where("o_orderkey % 5 = 0").select(name(1000))).select("granule", "source")


@query("""WITH t AS (SELECT (l_orderkey % 140) - 70 AS a, (l_partkey % 340) - 170 AS o FROM lineitem), u AS (SELECT DISTINCT a, o FROM t)
SELECT a AS lat, o AS lon, 'Copernicus_DSM_COG_10_' || CASE WHEN a >= 0 THEN 'N' ELSE 'S' END || lpad(abs(a)::VARCHAR, 2, '0') || '_00_' || CASE WHEN o >= 0 THEN 'E' ELSE 'W' END || lpad(abs(o)::VARCHAR, 3, '0') || '_00_DEM' AS tile,
  CASE WHEN a >= 0 THEN 32600 ELSE 32700 END + least(60, floor((o + 180) / 6)::INT + 1) AS epsg FROM u""")
def tile_names(spark, sf):
    u = table(spark, sf, "lineitem").select(((F.col("l_orderkey") % 140) - 70).alias("lat"), ((F.col("l_partkey") % 340) - 170).alias("lon")).distinct()
    return u.select("lat", "lon", X.cop30_tile("lat", "lon").alias("tile"), X.utm_epsg("lat", "lon").alias("epsg"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = window_counts(table(spark, sf, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return sessions(table(spark, sf, "events"), gap="6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH m AS (SELECT station_id, n_name, s_lat, s_lon FROM ({STATIONS})), x AS (SELECT s_nationkey AS station_id, count(*) AS n, min(s_acctbal) / 100 AS low FROM supplier GROUP BY 1)
SELECT m.station_id, coalesce(n, 0) AS n, CASE WHEN abs(coalesce(n, 0) - 4) <= 1 THEN 'near' ELSE 'far' END AS mark FROM m LEFT JOIN x USING (station_id)""")
def station_marks(spark, sf):
    x = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("station_id")).agg(F.count("*").alias("n"))
    out = stations(spark, sf).select("station_id").join(x, "station_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("mark", F.when(X.is_close("n", F.lit(4.0), rtol=0, atol=1), "near").otherwise("far"))


@query("""WITH l AS (SELECT station_id, radius_km, n FROM (SELECT s_nationkey AS station_id, (s_suppkey % 4 + 1) * 1.0::DOUBLE AS radius_km, count(*) AS n FROM supplier GROUP BY 1, 2))
SELECT station_id, arg_min(radius_km, abs(radius_km - 2) + CASE WHEN radius_km < 2 THEN 1e-6 ELSE 0 END) FILTER (n >= 2) AS reported_radius_km FROM l GROUP BY 1""")
def reported_radius(spark, sf):
    l = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("station_id"), ((F.col("s_suppkey") % 4 + 1) * F.lit(1.0)).alias("radius_km")).agg(F.count("*").alias("n"))
    return matchups.reported_radius(l, few=2)


_SMALL = "SELECT iy, ix, 46.7::DOUBLE + iy * 0.05::DOUBLE AS lat, 33.35::DOUBLE + ix * 0.11::DOUBLE AS lon FROM generate_series(0, 19) a(iy) CROSS JOIN generate_series(0, 17) b(ix)"


@query(f"""WITH d AS (SELECT g.*, n_name, station_id, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM ({_SMALL}) g CROSS JOIN ({STATIONS}))
SELECT iy::INT AS iy, ix::INT AS ix, round(station_id * 0.01::DOUBLE, 6) AS value, n_name AS station FROM d QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY km, station_id) = 1""")
def corrector_grid(spark, sf):
    known = [(r["n_name"], r["s_lat"], r["s_lon"], r["station_id"] * 0.01, None) for r in sorted(stations(spark, sf).collect(), key=lambda r: r["station_id"])]  # a dimension table of 25 rows
    return grids.corrector_grid(spark, grids.Axis(46.7, 33.35, 0.05, 0.11, 20, 18), known).select("iy", "ix", r6("value"), "station")


_TILES = "SELECT y AS tile_lat, x AS tile_lon, r AS row, c AS col, CASE WHEN (r + c) % 7 <> 0 THEN y * 100.0::DOUBLE + x + r * 0.1::DOUBLE + c * 0.01::DOUBLE ELSE -99999.0 END AS value FROM generate_series(46, 47) a(y) CROSS JOIN generate_series(33, 34) b(x) CROSS JOIN generate_series(0, 9) d(r) CROSS JOIN generate_series(0, 9) e(c)"


@query(f"""WITH t AS ({_TILES}), p AS (SELECT DISTINCT l_orderkey, {GEO} FROM lineitem)
SELECT l_orderkey, lat, round(CASE WHEN abs(value) <= 10000 THEN value END, 6) AS dem FROM p LEFT JOIN t ON tile_lat = floor(lat) AND tile_lon = floor(lon) AND row = least(9, floor((floor(lat) + 1 - lat) * 10)) AND col = least(9, floor((lon - floor(lon)) * 10))""")
def tile_sample(spark, sf):
    n = spark.range(400).select((46 + (F.col("id") / 200).cast("int")).alias("tile_lat"), (33 + ((F.col("id") / 100).cast("int") % 2)).alias("tile_lon"), ((F.col("id") / 10).cast("int") % 10).alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    value = F.when((F.col("row") + F.col("col")) % 7 != 0, F.col("tile_lat") * F.lit(100.0) + F.col("tile_lon") + F.col("row") * F.lit(0.1) + F.col("col") * F.lit(0.01)).otherwise(F.lit(-99999.0))
    p = items(spark, sf).select("l_orderkey", "lat", "lon").distinct()
    return grids.sample_tiles(p, n.withColumn("value", value), 10, "dem").select("l_orderkey", "lat", r6("dem"))


@query("""WITH g AS (SELECT s_nationkey, s_suppkey % 3 AS k, count(*) AS n, median(s_acctbal) AS m FROM supplier GROUP BY 1, 2)
SELECT s_nationkey, round(CASE WHEN count(m) > 1 THEN max(m) - min(m) END, 6) AS spread FROM g WHERE n >= 2 GROUP BY 1""")
def spread_by_station(spark, sf):
    g = table(spark, sf, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 3).alias("k")).agg(F.count("*").alias("n"), F.median("s_acctbal").alias("m"))
    return rounded(robust.spread_by(g, ["s_nationkey"], "m", "n", 2), "spread")
