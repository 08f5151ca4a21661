"""Queries over regions, heights, gauges, correctors and jobs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import grids, heights, joins, matchups, models, robust
from tidemark.plans import catalog, store
from tidemark.plans.catalog import _CONTROL, _EDGES, _GRID, AXIS, FIRST, GEO, HOLE, ITEMS, KM, LAST, PERIOD, RING, STATIONS, _controls, _grid, items, r6, rounded, stations, table
from tidemark.plans.folders import local_folder
from tidemark.sources import gauges, rasters, readers, regions, requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


LAKE = regions.Region("lake", "Lake", "lake", "egm2008", bbox=(33.4, 46.8, 35.0, 47.6))
RESERVOIR = regions.Region("reservoir", "Reservoir", "reservoir", "egg2015", True, bbox=(33.4, 46.8, 35.0, 47.6), polygon=f'{{"type": "Polygon", "coordinates": {[[list(p) for p in r] for r in (RING, HOLE)]}}}')
RIVER = regions.Region("river", "River", "river", "egm2008", bbox=(33.4, 46.8, 35.0, 47.6))

# zeta of each distinct point, bilinear in the test grid
_ZETA = f"""WITH g AS ({_GRID}), p AS (SELECT DISTINCT l_orderkey, l_linenumber, {GEO}, l_extendedprice / 1000 AS h, l_shipdate FROM lineitem),
f AS (SELECT *, (lat - 46.6::DOUBLE) / 0.05::DOUBLE AS fy, (lon - 33.2::DOUBLE) / 0.1::DOUBLE AS fx FROM p),
c AS (SELECT *, CASE WHEN fy BETWEEN 0 AND 29 AND fx BETWEEN 0 AND 24 THEN greatest(0, least(floor(fy), 28)) END AS jy, CASE WHEN fy BETWEEN 0 AND 29 AND fx BETWEEN 0 AND 24 THEN greatest(0, least(floor(fx), 23)) END AS jx FROM f),
z AS (SELECT c.*, a.value * (1 - (fy - jy)) * (1 - (fx - jx)) + b.value * (1 - (fy - jy)) * (fx - jx) + d.value * (fy - jy) * (1 - (fx - jx)) + e.value * (fy - jy) * (fx - jx) AS zeta
  FROM c LEFT JOIN g a ON a.iy = jy AND a.ix = jx LEFT JOIN g b ON b.iy = jy AND b.ix = jx + 1 LEFT JOIN g d ON d.iy = jy + 1 AND d.ix = jx LEFT JOIN g e ON e.iy = jy + 1 AND e.ix = jx + 1)
"""


def _points(spark, sf):
    return items(spark, sf).select("l_orderkey", "l_linenumber", "lat", "lon", (F.col("l_extendedprice") / 1000).alias("h"), F.col("l_shipdate").alias("time")).distinct()


@query(_ZETA + "SELECT l_orderkey, l_linenumber, lat, round(zeta, 6) AS N_m, round(h - zeta, 6) AS H_m, round(h - zeta, 6) AS H_egm2008_m, 'EGM2008' AS vertical_datum FROM z")
def heights_egm2008(spark, sf):
    out = heights.add_heights(_points(spark, sf), "h", LAKE, undulation=(_grid(spark), AXIS))
    return rounded(out.select("l_orderkey", "l_linenumber", "lat", "N_m", "H_m", "H_egm2008_m", "vertical_datum"), "N_m", "H_m", "H_egm2008_m")


@query(_ZETA + f""", e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
i AS (SELECT l_orderkey, l_linenumber, lat, lon, h, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AND
      NOT bool_or((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside FROM p CROSS JOIN e GROUP BY ALL)
SELECT z.l_orderkey, z.l_linenumber, z.lat, inside AS water_mask_pass, round(zeta, 6) AS zeta_egg2015_m, round(z.h - zeta, 6) AS H_evrs_egg2015_m, round(zeta - 15, 6) AS egm2008_minus_evrs_m,
  round(z.h - zeta, 6) AS H_m, 'EVRS_EGG2015' AS vertical_datum, {PERIOD('l_shipdate')} AS period FROM z JOIN i ON z.l_orderkey = i.l_orderkey AND z.l_linenumber = i.l_linenumber AND z.lat = i.lat AND z.lon = i.lon AND z.h = i.h""")
def heights_evrs(spark, sf):
    p = _points(spark, sf).withColumn("H_egm2008_m", F.col("h") - 15)
    out = heights.to_heights(p, RESERVOIR, "ATL13", "h", geoid=(_grid(spark), AXIS), last_before=LAST, first_after=FIRST)
    out = out.select("l_orderkey", "l_linenumber", "lat", "water_mask_pass", "zeta_egg2015_m", "H_evrs_egg2015_m", "egm2008_minus_evrs_m", "H_m", "vertical_datum", "period")
    return rounded(out, "zeta_egg2015_m", "H_evrs_egg2015_m", "egm2008_minus_evrs_m", "H_m")


@query(f"""WITH p AS (SELECT *, lon > 33.4 AND lon < 35.0 AND lat > 46.8 AND lat < 47.6 AS inside FROM ({ITEMS}) WHERE h IS NOT NULL),
l AS (SELECT 'lake' AS region, l_suppkey, l_returnflag, count(*) AS n_points, median(h) AS m FROM p WHERE inside GROUP BY ALL)
SELECT region, l_suppkey, l_returnflag, n_points, round(m, 6) AS median_wse_m, 'EGM2008' AS vertical_datum FROM l
UNION ALL SELECT 'river', l_suppkey, l_returnflag, n_points, round(m, 6), 'EGM2008' FROM l""")
def levels_by_kind(spark, sf):
    p = items(spark, sf).withColumn("H_m", F.col("height_m"))
    p = heights.add_water_mask(p, LAKE)
    one = lambda r: heights.levels_by_kind(p, r, keys=("l_suppkey", "l_returnflag")).select(F.lit(r.slug).alias("region"), "l_suppkey", "l_returnflag", "n_points", r6("median_wse_m"), "vertical_datum")
    return one(LAKE).unionByName(one(RIVER))


@query("""WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'r' || c_nationkey END AS region_slug, CASE WHEN c_custkey % 10 = 0 THEN 'own ' || c_custkey END AS inline FROM customer),
c AS (SELECT 'r' || n_nationkey AS slug, 'configured ' || n_name AS d FROM nation WHERE n_nationkey < 10), r AS (SELECT 'r' || n_nationkey AS slug, 'registered ' || n_name AS d FROM nation WHERE n_nationkey BETWEEN 5 AND 19)
SELECT c_custkey, coalesce(inline, c.d, r.d) AS definition, CASE WHEN inline IS NOT NULL THEN 'inline' WHEN c.d IS NOT NULL THEN 'configured' WHEN r.d IS NOT NULL THEN 'registered' END AS origin,
  CASE WHEN coalesce(inline, c.d, r.d) IS NULL THEN 'unknown region ' || coalesce(region_slug, '') END AS error FROM q LEFT JOIN c ON c.slug = region_slug LEFT JOIN r ON r.slug = region_slug""")
def resolve_region(spark, sf):
    n, key = table(spark, sf, "nation"), F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("slug")
    have = lambda cond, word: n.where(cond).select(key, F.concat(F.lit(f"{word} "), "n_name").alias("definition"))
    q = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))).alias("region_slug"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("own "), F.col("c_custkey").cast("string"))).alias("inline"))
    return regions.resolved(q, have("n_nationkey < 10", "configured"), have("n_nationkey between 5 and 19", "registered")).select("c_custkey", "definition", "origin", "error")


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate::DATE AS date, {GEO} FROM lineitem),
q AS (SELECT *, floor((lat - 46.6::DOUBLE) / 0.05::DOUBLE + 0.5)::INT AS iy, floor((lon - 33.2::DOUBLE) / 0.1::DOUBLE + 0.5)::INT AS ix FROM p)
SELECT month(date) AS month, count(*) AS n, sum(CASE WHEN lon > 33.4 AND lon < 35.0 AND lat > 46.8 AND lat < 47.6 AND (month(date) % 2 = 1 OR ((iy + ix) % 3 = 0 AND iy BETWEEN 0 AND 29 AND ix BETWEEN 0 AND 24)) THEN 1 ELSE 0 END)::BIGINT AS wet FROM q GROUP BY 1""")
def dated_water_mask(spark, sf):
    p = items(spark, sf).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), "lat", "lon").distinct()
    days = p.select("date").distinct().where("month(date) % 2 = 0")
    masks = days.crossJoin(F.broadcast(grids.lattice(spark, AXIS).select("iy", "ix", ((F.col("iy") + F.col("ix")) % 3 == 0).cast("int").alias("water"))))  # one small mask for each day
    out = heights.add_water_mask(p, LAKE, masks, AXIS)
    return out.groupBy(F.month("date").alias("month")).agg(F.count("*").alias("n"), F.count_if("water_mask_pass").alias("wet"))


@query(f"SELECT l_suppkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM (SELECT l_suppkey, {GEO} FROM lineitem) GROUP BY 1")
def search_bounds(spark, sf):
    return regions.bounds_of_points(items(spark, sf), ["l_suppkey"])


@query("""WITH j AS (SELECT o_orderkey AS job_id, ['ATL13', 'ATL08', 'ATL03', 'ATL99'][(o_orderkey % 4 + 1)::INT] AS product, o_custkey % 3 = 0 AS slug, o_custkey % 5 = 0 AS region, o_custkey % 2 = 0 AS coord, o_orderdate::DATE AS a, o_orderdate::DATE + (o_custkey % 9 - 2)::INT AS b, o_custkey % 250 AS size, o_custkey % 7 = 0 AS classes, o_custkey % 14 = 0 AS odd, o_custkey % 11 = 0 AS chm FROM orders)
SELECT job_id, unnest(list_filter([CASE WHEN product = 'ATL99' THEN 'product' END, CASE WHEN slug = region THEN 'region' END, CASE WHEN a > b THEN 'dates' END, CASE WHEN size NOT BETWEEN 1 AND 200 THEN 'batch_size' END,
  CASE WHEN classes AND product <> 'ATL03' THEN 'atl03' END, CASE WHEN classes AND odd THEN 'classes' END, CASE WHEN chm AND product IN ('ATL13', 'ATL03') THEN 'variables' END, CASE WHEN product = 'ATL13' AND region AND NOT coord THEN 'coord' END], lambda x: x IS NOT NULL)) AS error FROM j""")
def job_rules(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    j = table(spark, sf, "orders").select(
        k.alias("job_id"), F.element_at(F.array(*map(F.lit, ("ATL13", "ATL08", "ATL03", "ATL99"))), (k % 4 + 1).cast("int")).alias("product"), F.when(c % 3 == 0, "slug").alias("region_slug"), (c % 5 == 0).alias("has_region"), (c % 2 == 0).alias("has_coord"),
        F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (c % 9 - 2).cast("int")).alias("end"), (c % 250).alias("batch_size"),
        F.when(c % 14 == 0, F.array(F.lit("atl08_ground"), F.lit("ground"))).when(c % 7 == 0, F.array(F.lit("atl08_ground"))).alias("classes"), F.when(c % 11 == 0, F.array(F.lit("dtm" ), F.lit("chm"))).alias("variables"),
    )
    return requests.job_table_errors(j)


@query("""WITH n AS (SELECT o_orderkey::VARCHAR AS granule, o_orderdate AS acquired FROM orders WHERE o_orderstatus NOT IN ('F')), o AS (SELECT *, row_number() OVER (ORDER BY acquired, granule) - 1 AS r FROM n QUALIFY r < 170)
SELECT granule, acquired, floor(r / 50)::INT AS batch FROM o""")
def request_batches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("granule"), F.col("o_orderdate").alias("acquired"), "o_orderstatus")
    done = o.select("granule", F.when(F.col("o_orderstatus") == "F", "loaded").otherwise("pending").alias("status"))
    return requests.request_batches(o.drop("o_orderstatus"), done, requests.product("atl13"), limit=170)


@query("""WITH g AS (SELECT l_returnflag, l_shipdate::DATE AS date, l_suppkey, count(*) AS n_points FROM lineitem GROUP BY ALL)
SELECT l_returnflag, date, l_suppkey, n_points FROM g QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n_points DESC, date DESC, l_suppkey DESC) = 1""")
def densest_pass(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("date"), "l_suppkey").agg(F.count("*").alias("n_points"))
    return matchups.densest(g, ["l_returnflag"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 3")
def worst_three(spark, sf):
    return matchups.worst(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])


@query(f"SELECT l_orderkey, l_linenumber, lat, lon FROM (SELECT *, {GEO} FROM lineitem) WHERE l_suppkey = 7 AND l_returnflag = 'R' AND l_linenumber = 2 ORDER BY lat, lon")
def one_pass_profile(spark, sf):
    return heights.one_pass(items(spark, sf), l_suppkey=7, l_returnflag="R", l_linenumber=2).select("l_orderkey", "l_linenumber", "lat", "lon")


# matchups: suppliers as passes at stations
_FOUND = """SELECT s_nationkey AS station_id, (s_suppkey % 3 + 1) * 1.0::DOUBLE AS radius_km, s_suppkey % 4 AS rgt, DATE '2020-01-01' + (s_suppkey % 9)::INT AS date, s_acctbal / 1000 AS c_a, s_acctbal / 1000 + (s_suppkey % 5) * 0.01::DOUBLE AS c_b, s_acctbal / 1000 - (s_suppkey % 2) * 0.02::DOUBLE AS c_c, s_suppkey * 0.1::DOUBLE AS median FROM supplier"""
_EMP = "count(v) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(median(dev), 6) AS mad, round(1.4826 * median(dev), 6) AS nmad, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.95), 9) AS p95, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr"
_STATS = ("median", "mean", "std", "mad", "nmad")
_REP = "SELECT station_id, arg_min(radius_km, abs(radius_km - 2) + CASE WHEN radius_km < 2 THEN 1e-6 ELSE 0 END) FILTER (n >= 5) AS reported_radius_km FROM (SELECT station_id, radius_km, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1"


def stats6(df: DataFrame, *more: str) -> DataFrame:
    """Statistics to six digits; percentiles, which may end in a five at the seventh, to nine."""
    return rounded(df.withColumns({c: F.round(c, 9) for c in ("p05", "p95", "iqr")}), *_STATS, *more)


def _found(spark, sf):
    k = F.col("s_suppkey")
    c = F.col("s_acctbal") / 1000
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("station_id"), ((k % 3 + 1) * F.lit(1.0)).alias("radius_km"), (k % 4).alias("rgt"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 9).cast("int")).alias("date"),
        c.alias("c_a"), (c + (k % 5) * F.lit(0.01)).alias("c_b"), (c - (k % 2) * F.lit(0.02)).alias("c_c"), (k * F.lit(0.1)).alias("median"),
    )


def _ladder(spark, sf):
    return robust.matchup_summary(_found(spark, sf), ["station_id", "radius_km"], "c_a")


@query(f"SELECT station_id, {_EMP} FROM (SELECT station_id, c_a AS v, abs(c_a - median(c_a) OVER (PARTITION BY station_id)) AS dev FROM ({_FOUND})) GROUP BY 1")
def empirical_stats(spark, sf):
    return stats6(matchups.empirical(_found(spark, sf), ["station_id"], "c_a"))


@query(f"""WITH f AS ({_FOUND}), w AS (SELECT *, c_a AS v, abs(c_a - median(c_a) OVER (PARTITION BY station_id, radius_km)) AS dev FROM f)
SELECT station_id, radius_km, {_EMP.replace('median(v), 6) AS median', 'median(v), 6) AS median')}, count(DISTINCT date) AS n_dates, count(DISTINCT rgt) AS n_rgts, array_to_string(list_sort(list(DISTINCT rgt)), ',') AS rgts, round(median(w.median), 6) AS median_level, CASE WHEN count(v) < 5 THEN 'LOW_SAMPLE' ELSE 'OK' END AS flag FROM w GROUP BY 1, 2""")
def corrector_by_radius(spark, sf):
    return stats6(matchups.by_radius(_found(spark, sf)), "median_level")


@query(f"""WITH f AS ({_FOUND}), r AS ({_REP}), x AS (SELECT f.* FROM f JOIN r USING (station_id) WHERE radius_km = reported_radius_km),
w AS (SELECT *, c_a AS v, abs(c_a - median(c_a) OVER (PARTITION BY station_id, rgt)) AS dev FROM x), s AS (SELECT station_id, median(c_a) AS m FROM x GROUP BY 1)
SELECT station_id, rgt, {_EMP}, count(DISTINCT date) AS n_dates, round(any_value(m), 6) AS station_median, round(median(v) - any_value(m), 6) AS rgt_bias, CASE WHEN count(v) < 5 THEN 'LOW_SAMPLE' ELSE 'OK' END AS flag FROM w JOIN s USING (station_id) GROUP BY 1, 2""")
def corrector_by_track(spark, sf):
    rep = matchups.reported_radius(_ladder(spark, sf)).where("reported_radius_km is not null")
    return stats6(matchups.by_track(_found(spark, sf), rep), "station_median", "rgt_bias")


@query(f"""WITH f AS ({_FOUND}), r AS ({_REP}), x AS (SELECT f.* FROM f JOIN r USING (station_id) WHERE radius_km = reported_radius_km),
w AS (SELECT *, c_a AS v, abs(c_a - median(c_a) OVER (PARTITION BY station_id)) AS dev FROM x),
e AS (SELECT station_id, {_EMP}, median(c_a) AS a, median(c_b) AS b, median(c_c) AS c FROM w GROUP BY 1),
l AS (SELECT station_id, CASE WHEN count(*) > 1 THEN max(m) - min(m) END AS s FROM (SELECT station_id, radius_km, median(c_a) AS m, count(*) AS n FROM f GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1)
SELECT r.station_id, reported_radius_km, coalesce(n, 0) AS n, median, mean, std, mad, nmad, p05, p95, iqr, round(greatest(a, b, c) - least(a, b, c), 6) AS temporal_spread, round(s, 6) AS radius_spread, 0.05::DOUBLE AS operation_accuracy_m, CASE WHEN coalesce(n, 0) < 5 THEN 'LOW_SAMPLE' ELSE 'OK' END AS flag
FROM r LEFT JOIN e USING (station_id) LEFT JOIN l USING (station_id)""")
def corrector_uncertainty(spark, sf):
    ladder = _ladder(spark, sf)
    out = matchups.uncertainty_table(_found(spark, sf), ladder, matchups.reported_radius(ladder), accuracy_m=0.05)
    return stats6(out.drop("sigma_gauge_zero_m", "sigma_egg2015_model_m", "sigma_atl13_bias_m"), "temporal_spread", "radius_spread")


@query(f"""WITH c AS (SELECT *, v - 0.1 * (station_id % 3) AS lo, v + 0.2 AS hi FROM ({_CONTROL})), m AS (SELECT *, abs(v - median(v) OVER ()) AS dev FROM c)
SELECT count(v) AS n, round(median(v), 6) AS median, round(1.4826 * median(dev), 6) AS nmad, round(stddev_samp(v), 6) AS std, round(max(v) - min(v), 6) AS "range", round(regr_slope(v, s_lat), 6) AS slope_s_lat, round(regr_intercept(v, s_lat), 4) AS intercept_s_lat, round(regr_r2(v, s_lat), 6) AS r2_s_lat, round(median((hi - lo) / 2), 6) AS ci_half FROM m""")
def cross_station(spark, sf):
    c = _controls(spark, sf).withColumns({"ci_low": F.col("v") - 0.1 * (F.col("station_id") % 3), "ci_high": F.col("v") + 0.2})
    out = matchups.cross_station(c, "v", ("s_lat",))
    return rounded(out.withColumn("intercept_s_lat", F.round("intercept_s_lat", 4)), "median", "nmad", "std", "range", "slope_s_lat", "r2_s_lat", "ci_half")


@query(f"""WITH d AS (SELECT p.*, n_name, station_id, {KM('lat', 'lon', 's_lat', 's_lon')} AS km FROM (SELECT DISTINCT l_orderkey, l_linenumber, {GEO} FROM lineitem) p CROSS JOIN ({STATIONS})),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, lat, lon ORDER BY km, station_id) = 1)
SELECT n_name AS station, count(*) AS n, round(any_value(station_id * 0.01::DOUBLE), 6) AS c_station_m, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km FROM b GROUP BY 1""")
def corrector_usage(spark, sf):
    known = [(r["n_name"], r["s_lat"], r["s_lon"], r["station_id"] * 0.01, 0.02) for r in sorted(stations(spark, sf).collect(), key=lambda r: r["station_id"])]  # a dimension table of 25 rows
    p = items(spark, sf).select("l_orderkey", "l_linenumber", "lat", "lon").distinct()
    return rounded(matchups.corrector_usage(joins.nearest_station(p, known)), "c_station_m", "mean_km", "max_km")


@query("SELECT count(*) AS points, sum(CASE WHEN l_quantity > 2 THEN 1 ELSE 0 END)::BIGINT AS water_segments, (SELECT count(*) FROM orders) AS pass_levels, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS pass_levels_qc FROM lineitem")
def job_statistics(spark, sf):
    p = table(spark, sf, "lineitem").withColumn("water_mask_pass", F.when(F.col("l_quantity") != 1, F.col("l_quantity") != 2))
    return store.job_statistics(p, table(spark, sf, "orders").withColumn("qc_pass", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")))


@query("SELECT c_custkey AS granule, count(o_orderkey) AS n_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rows_by_granule(spark, sf):
    look = table(spark, sf, "customer").select(F.col("c_custkey").alias("granule"), (F.col("c_custkey") % 100).alias("rgt"), F.floor(F.col("c_custkey") / 100).alias("cycle"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("rgt"), F.floor(F.col("o_custkey") / 100).alias("cycle"))
    return store.rows_by_granule(o, look).select("granule", "n_rows")


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS n_rgts, count(DISTINCT o_orderpriority) AS n_beams FROM orders GROUP BY 1")
def data_spans(spark, sf):
    return store.spans(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate", rgts="o_custkey", beams="o_orderpriority")


@query("""WITH l AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT u.user_id, CASE WHEN n > 1 THEN n END AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)""")
def passes_with_lines(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").alias("time"), F.col("value").alias("lon"), F.col("value").alias("lat"), "event_type")
    out = store.with_lines(e.select("user_id").distinct(), e.where("event_type = 'view'"), ["user_id"])
    return out.select("user_id", F.when(F.col("line").isNotNull(), F.size("line")).cast("bigint").alias("n"))


@query("""SELECT c_custkey, printf('%+.3f', c_acctbal::DOUBLE) AS signed, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS rank, concat_ws('+', CASE WHEN c_nationkey % 2 = 0 THEN 'PRE_BREACH' END, CASE WHEN c_nationkey % 3 = 0 THEN 'POST_BREACH' END) AS regimes FROM customer""")
def labels_and_maps(spark, sf):
    n = F.col("c_nationkey")
    c = table(spark, sf, "customer").withColumn("regimes", F.array_compact(F.array(F.when(n % 2 == 0, "PRE_BREACH"), F.when(n % 3 == 0, "POST_BREACH"))))
    return store.mapped(c, "c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}, 9, "rank").select("c_custkey", matchups.signed("c_acctbal").alias("signed"), "rank", matchups.regimes_label("regimes").alias("regimes"))


@query("""SELECT DISTINCT 'c' || c_custkey AS granule FROM customer WHERE c_custkey % 50 = 0 AND c_custkey <= 2000 UNION SELECT 'c' || s_suppkey FROM supplier UNION SELECT 'c' || n_nationkey FROM nation""")
def seed_fallback(spark, sf):
    name = lambda t, c: table(spark, sf, t).select(F.concat(F.lit("c"), F.col(c).cast("string")).alias("granule"))
    seed = table(spark, sf, "customer").where("c_custkey % 50 = 0 and c_custkey <= 2000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("granule"))
    return readers.seed_or_union(seed, name("supplier", "s_suppkey"), name("nation", "n_nationkey"))


@query("SELECT s_nationkey, list_sort(list(DISTINCT r)) AS radii FROM (SELECT s_nationkey, (s_suppkey % 4 + 1) * 1.0::DOUBLE AS r FROM supplier UNION ALL SELECT DISTINCT s_nationkey, unnest([2.0::DOUBLE, 0.5::DOUBLE]) FROM supplier) GROUP BY 1")
def radii_union(spark, sf):
    g = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_set((F.col("s_suppkey") % 4 + 1) * F.lit(1.0)).alias("r"))
    return g.select("s_nationkey", matchups.all_radii(F.col("r"), 2.0, 0.5).alias("radii"))


@query(f"SELECT count(v) AS n_stations, round(min(v), 6) AS min_m, round(max(v), 6) AS max_m, 'EPSG:4326' AS crs FROM ({_CONTROL})")
def raster_metadata(spark, sf):
    return rounded(store.raster_metadata(_controls(spark, sf), "v", crs="EPSG:4326"), "min_m", "max_m")


@query("""WITH o AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS h FROM orders GROUP BY 1), s AS (
  SELECT date, h, h / 10 AS local, h / 10 AS absolute, 'yearbook_csv' AS source, 1 AS p FROM o WHERE day(date) <= 8
  UNION ALL SELECT date, h + 1, NULL, 5 + (h + 1) / 100, 'donor_parquet', 3 FROM o WHERE day(date) BETWEEN 5 AND 20
  UNION ALL SELECT date, h + 2, NULL, 5 + (h + 2) / 100, 'donor_parquet_versioned', 4 FROM o WHERE day(date) >= 15)
SELECT date, round(h, 3) AS h_cm, round(local, 4) AS h_m_local, round(absolute, 5) AS h_bs77_m, source, date >= DATE '1995-06-17' AS post_breach FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY p) = 1""")
def downstream_stitch(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("h"))
    day = F.dayofmonth("date")
    book = o.where(day <= 8).select("date", F.lit("daily").alias("stat_type"), F.col("h").alias("water_level_cm"), (F.col("h") / 10).alias("water_level_m_abs"))
    monthly = book.withColumns({"stat_type": F.lit("monthly"), "water_level_cm": F.lit(0.0)})
    years = o.where(day.between(5, 20)).select("date", (F.col("h") + 1).alias("h_mean"), F.lit(0.0).alias("h_08"))
    snaps = o.where(day >= 15).select(F.lit("p").alias("post_id"), "date", F.lit("level").alias("variable"), (F.col("h") + 2).alias("value"), F.explode(F.array(F.lit("/version=1/daily/a"), F.lit("/tmp_2/daily/a"), F.lit("/version=1/monthly/a"))).alias("path"))
    parts = [gauges.from_yearbook(book.unionByName(monthly)), gauges.from_years(years, 5.0), gauges.from_versions(snaps, 5.0)]
    out = gauges.downstream_series(parts, {"id": "p"}, last_before=LAST, first_after=FIRST)
    return out.select("date", F.round("h_cm", 3).alias("h_cm"), F.round("h_m_local", 4).alias("h_m_local"), F.round("h_bs77_m", 5).alias("h_bs77_m"), "source", "post_breach")


@query(f"""WITH r AS (SELECT (user_id % 25)::VARCHAR AS station_id, ts, min(value) AS v FROM events GROUP BY 1, 2)
SELECT r.station_id, ts AS datetime, round(v * 0.01, 8) AS stage_m, round(CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 0.5 END + v * 0.01, 8) AS WSE_baltic_m FROM r JOIN nation ON n_nationkey::VARCHAR = r.station_id""")
def gauge_observations(spark, sf):
    st = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("station_id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") * F.lit(0.5)).alias("zero_m"))
    raw = table(spark, sf, "events").select((F.col("user_id") % 25).cast("string").alias("station_id"), F.col("ts").cast("timestamp").alias("local"), F.col("value").alias("stage_raw"))
    out = gauges.observations(raw, st, scale=0.01)
    return out.select("station_id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), F.round("stage_m", 8).alias("stage_m"), F.round("WSE_baltic_m", 8).alias("WSE_baltic_m"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value, NULL::VARCHAR AS lacking FROM events")
def typed_copy(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "value")
    return store.typed(e, "event_id bigint, k bigint, value double, lacking string")


@query("SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_ok FROM orders GROUP BY 1, 2")
def coverage_counts(spark, sf):
    o = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "ok": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")})
    return robust.coverage_counts(o, ["o_orderpriority", "year"], "ok")


@query("SELECT o_orderkey AS job_id, o_orderdate AS finished_at, 'failed' AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_failures(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("status"))
    return robust.recent_failures(o)


_RIVER = "SELECT l_suppkey, l_returnflag, median(l_tax * 40) AS median, 1.4826 * median(dev) AS nmad, count(*) AS n_points FROM (SELECT *, abs(l_tax * 40 - median(l_tax * 40) OVER (PARTITION BY l_suppkey, l_returnflag)) / 10 AS dev FROM lineitem) GROUP BY 1, 2"


@query(f"SELECT l_returnflag, count(*) AS n, round(median(median), 6) AS median, round(quantile_cont(median, 0.05), 6) AS p05, round(quantile_cont(median, 0.95), 6) AS p95 FROM ({_RIVER}) WHERE median < 3 AND nmad < 0.15 AND n_points >= 15 GROUP BY 1")
def river_plausibility(spark, sf):
    l = robust.robust_stats(table(spark, sf, "lineitem").withColumn("x", F.col("l_tax") * 40), ["l_suppkey", "l_returnflag"], "x").withColumn("nmad", F.col("nmad") / 10)
    return rounded(heights.level_ranges(heights.plausible_river_levels(l), "l_returnflag"), "median", "p05", "p95")


@query(f"SELECT l_suppkey, l_returnflag, 'gross' AS reason FROM (SELECT l_suppkey, l_returnflag, stddev_samp(l_tax) * 12 AS nmad, max(l_tax) * 25 - min(l_tax) * 25 AS r FROM lineitem GROUP BY 1, 2) WHERE nmad > 0.30 OR r > 2.0")
def gross_outliers(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg((F.stddev_samp("l_tax") * 12).alias("nmad"), (F.max("l_tax") * 25 - F.min("l_tax") * 25).alias("range_m"))
    return robust.gross_outliers(g).select("l_suppkey", "l_returnflag", "reason")


@query(f"""WITH c AS ({_CONTROL}), f AS (SELECT a.station_id, a.v AS seen, median(b.v) AS p FROM c a JOIN c b ON a.station_id <> b.station_id GROUP BY 1, 2), e AS (SELECT *, p - seen AS e FROM f)
SELECT 'constant' AS model, count(*) AS n_folds, count(e) AS n_predicted, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(median(abs(e)), 6) AS median_abs, round(max(abs(e)), 6) AS max_abs FROM e""")
def loso_constant(spark, sf):
    c = _controls(spark, sf).select(F.col("n_name").alias("slug"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), F.col("v").alias("value"))
    return rounded(models.cv_summary(models.leave_one_out(c, models=("constant",))), "bias", "mae", "rmse", "median_abs", "max_abs")


@query("""WITH d AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) / 1000 AS h FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-17' AND day(o_orderdate) % 3 = 1 GROUP BY 1),
p AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice / 1000 AS level FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-17' AND o_custkey % 20 <= 5),
b AS (SELECT p.*, d.date AS bt, d.h AS bv FROM p ASOF LEFT JOIN d ON p.day >= d.date), a AS (SELECT b.*, d.date AS ft, d.h AS fv FROM b ASOF LEFT JOIN d ON b.day <= d.date),
c AS (SELECT CASE WHEN bt = ft THEN bv ELSE bv + (fv - bv) * (day - bt) / (ft - bt) END + 0.25 - level AS v FROM a WHERE bt IS NOT NULL AND ft IS NOT NULL), w AS (SELECT *, abs(v - median(v) OVER ()) AS dev FROM c)
SELECT """ + _EMP + " FROM w")
def provisional_corrector(spark, sf):
    o = table(spark, sf, "orders").withColumns({"date": F.to_date("o_orderdate"), "period": X.period_label("o_orderdate", LAST, FIRST)})
    daily = o.where(F.dayofmonth("date") % 3 == 1).groupBy("date", "period").agg((F.avg("o_totalprice") / 1000).alias("h_bs77_m"))
    passes = o.select("period", F.col("o_orderdate").alias("datetime"), (F.col("o_totalprice") / 1000).alias("median"), (F.col("o_custkey") % 20).alias("station_km"))
    return stats6(matchups.provisional(passes, daily, km=5.0, delta=0.25, period="PRE_BREACH"))


@query(f"""WITH g AS ({_GRID}), s AS (SELECT station_id, s_lat AS lat, s_lon AS lon, floor((s_lat - 46.6::DOUBLE) / 0.05::DOUBLE + 0.5)::INT AS iy, floor((s_lon - 33.2::DOUBLE) / 0.1::DOUBLE + 0.5)::INT AS ix FROM ({STATIONS}))
SELECT station_id, round(g.value::FLOAT::DOUBLE, 6) AS exported, round(g.value, 6) AS original, round(abs(g.value::FLOAT::DOUBLE - g.value), 7) AS difference, coalesce(abs(g.value::FLOAT::DOUBLE - g.value) <= 1e-6, true) AS ok FROM s LEFT JOIN g USING (iy, ix)""")
def export_check(spark, sf):
    """A grid, the GeoTIFF that was written from it, and both at the stations."""
    s = stations(spark, sf).select("station_id", F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))
    grid, path = _grid(spark), local_folder(spark)
    cells = grid.select((F.lit(AXIS.ny - 1) - F.col("iy")).alias("row"), F.col("ix").alias("col"), "value")
    rasters.write_geotiff(cells, path, rasters.Frame.of_nodes(AXIS.lat0, AXIS.lon0, AXIS.dlat, AXIS.dlon, AXIS.ny, AXIS.nx), ["value"])
    exported = rasters.grid_of(rasters.read_geotiff(spark, path, band=1))
    at = lambda g: grids.sample_nearest(s, g, AXIS, "value")
    return store.checked_samples(at(exported), at(grid), ["station_id"], "value", 1e-6).withColumns({"exported": F.round("exported", 6), "original": F.round("original", 6), "difference": F.round("difference", 7)})


@query("""WITH p AS (SELECT * FROM (VALUES ('ATL13', '007', 'h_wgs84_m', 50, true, true, ['wse'], 0), ('ATL08', '007', 'h_te_median_m', 10, false, true, ['chm', 'dtm'], 1), ('ATL03', '007', 'height_m', 3, false, false, ['dtm'], 2)) t(product, version, height, batch, needs_coord, stored_points, rasters, k)),
j AS (SELECT o_orderkey % 3 AS k, count(*) AS jobs FROM orders GROUP BY 1)
SELECT product, version, height, batch::INT AS batch, needs_coord, stored_points, rasters, jobs, ((jobs + batch - 1) // batch)::BIGINT AS batches FROM p JOIN j USING (k)""")
def products(spark, sf):
    """What the service says of each product, with the jobs that ask for it and the batches they make."""
    jobs = table(spark, sf, "orders").groupBy(F.element_at(F.array(*map(F.lit, ("ATL13", "ATL08", "ATL03"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("product")).agg(F.count("*").alias("jobs"))
    return requests.products_table(spark).join(jobs, "product").withColumn("batches", F.expr("(jobs + batch - 1) div batch"))


@query(f"SELECT count(*) AS n, round(sum(h), 4) AS total FROM ({ITEMS}) WHERE coalesce(on_water, false)")
def dem_rows(spark, sf):
    d = heights.dem_rows(items(spark, sf).withColumn("water_mask_pass", F.col("on_water")), "ATL13")
    return d.agg(F.count("*").alias("n"), F.round(F.sum("height_m"), 4).alias("total"))


assert not set(QUERIES) & set(catalog.QUERIES)
