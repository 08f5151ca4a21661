"""Joins by time, place and priority, and keyed merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, finite, haversine_km

#: Sides of at most so many rows are sent to all executors; others are joined through cells of the earth.
SMALL_ROWS = 10_000
CELL_DEG = 0.25
#: Length of the spans of time that as-of joins deal series into: a year.
SPAN_HOURS = 8784.0


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in `order`; the order should break ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def lookup_first(left: DataFrame, right: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Left join with the first right row of each key; null keys find nothing."""
    return left.join(first_per_key(right, keys, order).select(*keys, *columns), keys, "left")


def asof(probes: DataFrame, series: DataFrame, *, key: str, at: str = "ts", ts: str = "ts", value: str = "value", method: str = "linear", max_gap_hours: float | None = 24.0, ends: str = "nearest", prefix: str = "", span_hours: float | None = SPAN_HOURS) -> DataFrame:
    """Each probe with <prefix>value, <prefix>interpolated and <prefix>gap_hours from the series of its key.

    The nearest observation (the earlier on a tie) must lie within max_gap_hours, else the value is null and the gap
    stays. "nearest" takes it; "linear" interpolates between the two around, also on an exact hit, and takes the nearest
    at or beyond the ends of the series (`ends` "null": nothing outside, no gap limit). Observations without value are
    passed over and repeated times keep their least value; keys without observations give null.

    One union and windows by key and span of time; no inequality join, and frames only grow, so the work is linear. Each
    span gets the observations before and after it from a table of spans, so a long series is dealt over many tasks; with
    span_hours None the windows go by key alone, which saves a join where all series are short. Results are the same."""
    obs = series.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), finite(value).alias("_v")).where("_v is not null and _t is not null")
    obs = obs.groupBy("_k", "_t").agg(F.min("_v").alias("_v"))
    side = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct("*").alias("_row"))
    both = side.withColumn("_side", F.lit(1)).unionByName(obs.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    part = ["_k"]
    if span_hours is not None:
        both = both.withColumn("_span", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (span_hours * 3.6e9)))
        part = ["_k", "_span"]
    w = Window.partitionBy(*part)
    back = w.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as frames to the end are summed anew for each row
    seen = both.withColumns({"_b": F.last(mark, True).over(back), "_f": F.last(mark, True).over(ahead)})
    if span_hours is None:
        whole, at_obs = Window.partitionBy("_k"), F.when(F.col("_side") == 0, F.col("_t"))
        seen = seen.withColumns({"_t0": F.min(at_obs).over(whole), "_t1": F.max(at_obs).over(whole)}).where("_side = 1")
    else:
        spans = both.groupBy("_k", "_span").agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
        s = Window.partitionBy("_k")
        before, after = (s.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_span", F.desc("_span")))
        spans = spans.select("_k", "_span", F.last("_hi", True).over(before).alias("_pb"), F.last("_lo", True).over(after).alias("_pf"), F.min("_lo").over(Window.partitionBy("_k")).alias("_first"), F.max("_hi").over(Window.partitionBy("_k")).alias("_last"))
        seen = seen.where("_side = 1").join(spans.withColumnRenamed("_k", "_k2").withColumnRenamed("_span", "_span2"), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_span") == F.col("_span2")), "left")
        seen = seen.withColumns({"_b": F.coalesce("_b", "_pb"), "_f": F.coalesce("_f", "_pf"), "_t0": F.col("_first.t"), "_t1": F.col("_last.t")})
    secs = lambda c: F.unix_micros(col(c).cast("timestamp")) / 1e6
    t, before, after = secs("_t"), secs("_b.t"), secs("_f.t")
    gap_b, gap_f = t - before, after - t
    earlier = gap_f.isNull() | (gap_b <= gap_f)
    gap = F.least(gap_b, gap_f) / 3600
    nearest = F.when(earlier & F.col("_b").isNotNull(), F.col("_b.v")).otherwise(F.col("_f.v"))
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * gap_b / (after - before)
    inner = (F.col("_t") > F.col("_t0")) & (F.col("_t") < F.col("_t1"))
    near_enough = F.lit(True) if max_gap_hours is None else gap <= max_gap_hours
    if method == "nearest":
        found, inter = nearest, F.lit(False)
    elif ends == "null":
        found = F.when(F.col("_t").between(F.col("_t0"), F.col("_t1")), F.when(F.col("_f").isNull() | (gap_b == 0), nearest).otherwise(line))
        inter = inner
    else:
        found, inter = F.when(inner, line).otherwise(nearest), inner
    ok = F.coalesce(near_enough, F.lit(False))
    return seen.select("_row.*", F.when(ok, found).alias(f"{prefix}value"), (ok & F.coalesce(inter, F.lit(False))).alias(f"{prefix}interpolated"), gap.alias(f"{prefix}gap_hours"))


def _columns(km: float) -> int:
    """Columns of cells around the earth: cells of CELL_DEG, larger for large circles, so that a circle touches tens of them."""
    return max(1, int(360 / max(CELL_DEG, km / 444)))


def _cell(c: Column, n: int) -> Column:
    return F.floor(c * (n / 360))


def _cells(lat, lon, km: float) -> Column:
    """Cells that a circle of `km` around a point can touch, each once; columns meet at the meridian of 180 degrees."""
    n, dlat = _columns(km), km / 111.0 + 1e-9
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.abs(col(lat)) + dlat)))
    dlon = F.when(narrow < 1e-3, F.lit(180.0)).otherwise(F.least(F.lit(180.0), dlat / narrow))
    span = lambda c, d: F.sequence(_cell(c - d, n), _cell(c + d, n))
    return F.array_distinct(F.flatten(F.transform(span(col(lat), F.lit(dlat)), lambda y: F.transform(span(col(lon), dlon), lambda x: F.struct(y.alias("cy"), F.pmod(x, F.lit(n)).alias("cx"))))))


def radius_join(points: DataFrame, stations: DataFrame, km: float, *, lat="lat", lon="lon", s_lat="s_lat", s_lon="s_lon", out="distance_km") -> DataFrame:
    """Pairs within `km`, by an equi-join on the cells that each station's circle touches; the cells of at most SMALL_ROWS
    stations go to all executors, which changes the plan and not the rows."""
    dist, n = haversine_km(lat, lon, s_lat, s_lon), _columns(km)
    there = stations.withColumn("_c", F.explode(_cells(s_lat, s_lon, km))).select("*", "_c.cy", "_c.cx").drop("_c")
    there = F.broadcast(there) if stations.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else there
    here = points.withColumns({"cy": _cell(F.col(lat), n), "cx": F.pmod(_cell(F.col(lon), n), F.lit(n))})
    return here.join(there, ["cy", "cx"]).drop("cy", "cx").where(dist <= km).withColumn(out, dist)


def nearest_station(points: DataFrame, stations: list[tuple], *, lat="lat", lon="lon") -> DataFrame:
    """Adds station, station_km, c_station_m and sigma_m of the nearest of `stations` (name, lat, lon, value, sigma).

    A tie goes to the first; stations without value take no part. The stations are literals in the plan, so there is no
    join at all; use it for at most a few hundred."""
    best = None
    for i, (name, y, x, value, sigma) in enumerate(s for s in stations if s[3] is not None and not math.isnan(s[3])):
        one = F.struct(haversine_km(lat, lon, F.lit(float(y)), F.lit(float(x))).alias("km"), F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(float(value)).alias("v"), F.lit(None if sigma is None else float(sigma)).cast("double").alias("s"))
        best = [one] if best is None else [*best, one]
    if best is None:
        raise ValueError("no station has a value")
    at = points.withColumn("_s", F.array_min(F.array(*best)))
    return at.withColumns({"station": F.col("_s.name"), "station_km": F.col("_s.km"), "c_station_m": F.col("_s.v"), "sigma_m": F.col("_s.s")}).drop("_s")


def augmented(points: DataFrame, stations: list[tuple], level: str, out: str, *, lat="lat", lon="lon") -> DataFrame:
    """Level plus the nearest station's corrector."""
    return nearest_station(points, stations, lat=lat, lon=lon).withColumn(out, F.col(level) + F.col("c_station_m"))


def not_done(candidates: DataFrame, status: DataFrame, key: str, done=("loaded", "empty")) -> DataFrame:
    return candidates.join(status.where(F.col("status").isin(*done)).select(key), key, "left_anti")


def split_hits(batch: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Each member of a batch with status loaded or empty, by whether rows came back for it."""
    hit = returned.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return batch.join(hit, keys, "left").withColumn("status", F.when(F.col("_hit"), "loaded").otherwise("empty")).drop("_hit")


def merged(old: DataFrame, new: DataFrame, keys: list[str], *, keep_old_if_null: tuple[str, ...] = (), guard: Column | None = None) -> DataFrame:
    """Upsert: of a key both have, the new row counts. Columns in keep_old_if_null keep the old value where the new one is
    null. `guard` is over columns o.* and n.*; where it is false the old row stays. Later rows of `new` repeat no key."""
    o, n = old.select(*keys, F.struct("*").alias("o")), new.select(*keys, F.struct("*").alias("n"))
    both = o.join(n, keys, "full")
    take = F.col("n").isNotNull() & (F.col("o").isNull() | (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)))
    pick = lambda c: F.when(take, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_if_null else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(pick(c).alias(c) for c in old.columns))
