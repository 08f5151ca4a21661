"""Passes against gauges: matchups, radius ladders, alignment constants, decomposition, empirical correctors.

Stations and radii are a small dimension table in one plan, not loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import MEDIAN_SE, NMAD, col, finite, is_close, joined_ints, local_flags, truthy
from tidemark.operators.joins import asof, radius_join
from tidemark.operators.models import bootstrap_median
from tidemark.operators.robust import matchup_summary, residual_stats, spread_columns, with_all, with_deviation

#: Matchups that a radius needs to be reported.
FEW = 5
MAIN_RADIUS = 2.0


def usable(stations: DataFrame) -> DataFrame:
    """Stations with place and zero."""
    return stations.where("s_lat is not null and s_lon is not null and zero_m is not null")


def matchups(passes: DataFrame, observations: DataFrame, stations: DataFrame, *, km: float = 60.0, hours: float = 12.0, qc_only: bool = True) -> DataFrame:
    """Pass × station within `km` and an active regime, with the interpolated stage and the residual level − stage.

    `stations` has station_id, s_lat, s_lon, zero_m and optionally regimes, an array; empty or null takes all periods."""
    rows = passes.where(truthy("qc_pass")) if qc_only else passes
    pairs = radius_join(rows, usable(stations), km, lat="lat_mean", lon="lon_mean")
    if "regimes" in stations.columns:
        pairs = pairs.where(F.coalesce(F.size("regimes") <= 0, F.lit(True)) | F.array_contains("regimes", F.col("period")))
    out = asof(pairs, observations, key="station_id", at="datetime", ts="datetime", value="stage_m", max_gap_hours=hours, prefix="stage_")
    return out.where("stage_value is not null").withColumn("residual", F.col("median") - F.col("stage_value"))


def local_passes(points: DataFrame, stations: DataFrame, radii: list[float], reservoir: DataFrame | None = None, *, height="height_m") -> DataFrame:
    """Levels of passes rebuilt inside each radius of each station, with distances, flags and qc_pass.

    `points` has date, rgt, beam, time, lat, lon, period, on_water and the height. `reservoir` has date and
    reservoir_level; where it has no level for a date the level check does not apply."""
    near = radius_join(points.where(truthy("on_water")), stations, max(radii))
    near = near.withColumn("radius_km", F.explode(F.filter(F.array(*(F.lit(float(r)) for r in radii)), lambda r: F.col("distance_km") <= r)))
    keys = ["station_id", "radius_km", "date", "rgt", "beam"]
    rows = with_deviation(near.withColumn("_v", finite(height)), keys, "_v")
    out = rows.groupBy(*keys).agg(
        F.min("time").alias("datetime"), *(c.alias(n) for n, c in spread_columns("_v").items()),
        F.avg("distance_km").alias("mean_distance_km"), F.min("distance_km").alias("min_distance_km"),
        F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"), F.mode("period", True).alias("period"),
    ).where("n_points > 0")
    out = out.join(reservoir, "date", "left") if reservoir is not None else out.withColumn("reservoir_level", F.lit(None).cast("double"))
    out = out.withColumn("reservoir_deviation", F.col("median") - F.col("reservoir_level"))
    out = out.withColumn("qc_flags", local_flags("n_points", "nmad", "reservoir_deviation"))
    return out.withColumn("qc_pass", F.col("qc_flags") == "")


def with_reservoir_qc(passes: DataFrame, reservoir_passes: DataFrame) -> DataFrame:
    return passes.join(reservoir_passes.select("date", "rgt", "beam", F.col("qc_pass").alias("reservoir_qc_pass")), ["date", "rgt", "beam"], "left")


def local_matchups(passes: DataFrame, observations: DataFrame, stations: DataFrame, *, hours: float = 12.0, method: str = "linear", prefix: str = "stage_") -> DataFrame:
    """Good local passes with the stage at their time; c = level − stage, and the level above the station's zero."""
    out = asof(passes.where("qc_pass"), observations, key="station_id", at="datetime", ts="datetime", value="stage_m", method=method, max_gap_hours=hours, prefix=prefix)
    out = out.where(F.col(f"{prefix}value").isNotNull()).join(F.broadcast(stations.select("station_id", "zero_m")), "station_id")  # a config table
    return out.withColumns({"c": F.col("median") - F.col(f"{prefix}value"), "difference": F.col("median") - F.col("zero_m") - F.col(f"{prefix}value")})


def radius_ladder(found: DataFrame, stations: DataFrame, radii: list[float], value: str = "c") -> DataFrame:
    """matchup_summary() for each station and radius; radii without matchups are rows with n 0."""
    rungs = stations.select("station_id", F.explode(F.array(*(F.lit(float(r)) for r in radii))).alias("radius_km"))
    s = matchup_summary(found, ["station_id", "radius_km"], value)
    out = rungs.join(s, ["station_id", "radius_km"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_dates": F.coalesce("n_dates", F.lit(0)), "n_rgts": F.coalesce("n_rgts", F.lit(0)), "indicative": F.coalesce("indicative", F.lit(True))})


def per_track(found: DataFrame, radius: float, value: str = "c") -> DataFrame:
    """Per station and track at one radius, and ALL: n, median, nmad, and the bias against ALL."""
    rows = with_deviation(found.where(is_close("radius_km", F.lit(radius))).withColumn("_v", finite(value)), ["station_id", "rgt"], "_v")
    whole = with_deviation(rows, ["station_id"], "_v", "_all")
    aggs = {"n": F.count("_v"), "median": F.median("_v"), "nmad": F.when(F.bool_and("_k.t"), NMAD * F.median("_all")).otherwise(NMAD * F.median("_dev"))}
    out = with_all(whole, ["station_id"], "rgt", aggs)
    pooled = F.max(F.when(F.col("is_total"), F.col("median"))).over(Window.partitionBy("station_id"))
    return out.withColumn("bias", F.col("median") - pooled)


def reported_radius(ladder: DataFrame, main: float = MAIN_RADIUS, few: int = FEW) -> DataFrame:
    """The radius nearest to `main` with enough matchups, the larger of two as near; null if none has."""
    cost = F.abs(F.col("radius_km") - main) + F.when(F.col("radius_km") < main, 1e-6).otherwise(0.0)
    return ladder.groupBy("station_id").agg(F.min_by("radius_km", F.when(F.col("n") >= few, cost)).alias("reported_radius_km"))


def station_summary(ladder: DataFrame, main: float = MAIN_RADIUS, few: int = FEW) -> DataFrame:
    """The main radius if it has enough matchups, else the smallest that has, else none, with a note that says which."""
    pick = ladder.groupBy("station_id").agg(F.max(F.when(is_close("radius_km", F.lit(main)) & (F.col("n") >= few), F.col("radius_km"))).alias("_main"), F.min(F.when(F.col("n") >= few, F.col("radius_km"))).alias("_least"))
    pick = pick.select("station_id", F.coalesce("_main", "_least").alias("radius_km"), F.when(F.col("_main").isNotNull(), "main radius").when(F.col("_least").isNotNull(), F.format_string("fewer than %d matchups at the main radius", F.lit(few))).otherwise("no radius has enough matchups").alias("note"))
    return pick.join(ladder, ["station_id", "radius_km"], "left")


def alignment(found: DataFrame, value: str = "residual") -> DataFrame:
    """Residual statistics per station and ALL. `value_mean` is the reported constant, `value_median` its robust sibling."""
    one = residual_stats(found, ["station_id"], value).withColumns({"station": F.col("station_id").cast("string"), "is_total": F.lit(False)}).drop("station_id")
    v = finite(value)
    rows = found.select(v.alias("_v")).crossJoin(found.agg(F.median(v).alias("_m")))  # one row
    half = 1.96 * F.stddev_samp("_v") / F.sqrt(F.count("_v"))
    all_ = rows.agg(
        F.count("_v").alias("n"), F.avg("_v").alias("bias"), F.avg(F.abs("_v")).alias("mae"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rmse"), F.stddev_samp("_v").alias("std"),
        (NMAD * F.median(F.abs(F.col("_v") - F.col("_m")))).alias("nmad"), F.median("_v").alias("median"), (F.avg("_v") - half).alias("ci_low"), (F.avg("_v") + half).alias("ci_high"),
    ).withColumns({"station": F.lit("ALL"), "is_total": F.lit(True)})
    return one.unionByName(all_).withColumnsRenamed({"bias": "value_mean", "median": "value_median"})


def decompose(summary: DataFrame, *, low: float, high: float, constant="alignment_constant_m", zero="gauge_zero_m", correction="correction_m") -> DataFrame:
    """Constant = zero + official correction + rest; `plausible` tells whether the rest lies in [low, high]."""
    rest = F.col(constant) - F.col(zero) - F.col(correction)
    return summary.withColumns({"observed_offset_m": F.col(constant) - F.col(zero), "unexplained_m": rest, "plausible": rest.between(low, high)})


def decompose_by(found: DataFrame, keys: list[str], value: str, zero: float, correction: float) -> DataFrame:
    s = matchup_summary(found, keys, value).where("n > 0").select(*keys, "n", "median", "nmad")
    return s.withColumn("unexplained_m", F.col("median") - zero - correction)


def correctors(passes: DataFrame, term: DataFrame, daily: DataFrame, stations: DataFrame, *, hours: float = 12.0, daily_hours: float = 18.0) -> DataFrame:
    """c = zero + stage + delta − level by three stages: A linear and B nearest in term readings, C linear in daily means.

    `stations` has station_id, zero_m and delta_m; a row needs A."""
    rows = passes.where("qc_pass")
    for series, method, limit, name in ((term, "linear", hours, "a"), (term, "nearest", hours, "b"), (daily, "linear", daily_hours, "c")):
        rows = asof(rows, series, key="station_id", at="datetime", ts="datetime", value="stage_m", method=method, max_gap_hours=limit, prefix=f"{name}_")
    rows = rows.where("a_value is not null").join(F.broadcast(stations.select("station_id", "zero_m", "delta_m")), "station_id")  # a config table
    return rows.withColumns({f"c_{n}": F.col("zero_m") + F.col(f"{n}_value") + F.col("delta_m") - F.col("median") for n in "abc"})


def corrector_stations(found: DataFrame, reported: DataFrame) -> DataFrame:
    """Medians of the three strategies at each station's reported radius, their spread, and the uncertainty of A."""
    rows = found.join(reported, "station_id").where(is_close("radius_km", "reported_radius_km"))
    rows = with_deviation(rows, ["station_id", "reported_radius_km"], "c_a")
    med = [F.median(f"c_{n}").alias(f"c_{n}") for n in "abc"]
    out = rows.groupBy("station_id", "reported_radius_km").agg(F.count("c_a").alias("n"), *med, (NMAD * F.median("_dev")).alias("nmad"), F.stddev_samp("c_a").alias("std"))
    half = 1.96 * MEDIAN_SE * F.col("nmad") / F.sqrt("n")
    low_sample = F.when(F.col("n") < FEW, "LOW_SAMPLE").otherwise("OK")
    return out.withColumns({"temporal_spread": F.greatest("c_a", "c_b", "c_c") - F.least("c_a", "c_b", "c_c"), "ci_half": F.when(F.col("n") > 1, half), "flag": low_sample})


def corrector_uncertainty(stations: DataFrame, ladder: DataFrame, few: int = FEW) -> DataFrame:
    """Adds radius_spread, the range of medians over radii with enough matchups; null with fewer than two of them."""
    s = ladder.where(F.col("n") >= few).groupBy("station_id").agg(F.count("*").alias("_r"), (F.max("median") - F.min("median")).alias("_s"))
    return stations.join(s.select("station_id", F.when(F.col("_r") > 1, F.col("_s")).alias("radius_spread")), "station_id", "left")


def cross_station(stations: DataFrame, value: str = "c_a", against: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """One row: spread of the stations' values, the median half-width of their intervals if they have one (ci_low, ci_high), and least-squares
    slopes against places or whatever `against` names; a fit needs three stations."""
    rows = stations.withColumn("_dev", F.abs(F.col(value) - F.median(value).over(Window.partitionBy(F.lit(0)))))
    three = lambda x, c: F.when(F.regr_count(value, x) >= 3, c)
    fits = [c for x in against for c in (three(x, F.regr_slope(value, x)).alias(f"slope_{x}"), three(x, F.regr_intercept(value, x)).alias(f"intercept_{x}"), three(x, F.when(F.regr_syy(value, x) > 0, F.regr_r2(value, x))).alias(f"r2_{x}"))]
    if {"ci_low", "ci_high"} <= set(stations.columns):
        fits.append(F.median((F.col("ci_high") - F.col("ci_low")) / 2).alias("ci_half"))
    return rows.agg(F.count(value).alias("n"), F.median(value).alias("median"), (NMAD * F.median("_dev")).alias("nmad"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range"), *fits)


def outliers(found: DataFrame, stations: DataFrame, limit: float = 0.12) -> DataFrame:
    """Matchups at the reported radius that lie more than `limit` from their station's value."""
    s = stations.select("station_id", "reported_radius_km", F.col("c_a").alias("station_c"))
    return found.join(s, "station_id").where(is_close("radius_km", "reported_radius_km") & (F.abs(F.col("c_a") - F.col("station_c")) > limit))


def empirical(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, mean, std, mad, nmad, p05, p95 and iqr of the finite values of each group."""
    iqr = F.percentile("_v", 0.75) - F.percentile("_v", 0.25)
    rows = with_deviation(df.withColumn("_v", finite(value)), keys, "_v")
    return rows.groupBy(*keys).agg(*(c.alias("n" if n == "n_points" else n) for n, c in spread_columns("_v").items()), iqr.alias("iqr"))


def with_interval(stats: DataFrame, df: DataFrame, keys: list[str], value: str, order: list[str], **options) -> DataFrame:
    """Adds the bootstrap interval of the median to rows of `keys`."""
    return stats.join(bootstrap_median(df, keys, value, order, **options).drop("n"), keys, "left")


def low_sample(n: str = "n", few: int = FEW) -> Column:
    return F.when(F.col(n) < few, "LOW_SAMPLE").otherwise("OK")


def by_radius(found: DataFrame, keys: tuple[str, ...] = ("station_id", "radius_km"), *, value="c_a", level="median") -> DataFrame:
    """One row for each station and radius: spread of the corrector, dates, tracks, the median level and a flag."""
    more = found.groupBy(*keys).agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("rgt").alias("n_rgts"), joined_ints("rgt").alias("rgts"), F.median(level).alias("median_level"))
    return empirical(found, list(keys), value).join(more, list(keys)).withColumn("flag", low_sample())


def by_track(found: DataFrame, reported: DataFrame, *, value="c_a") -> DataFrame:
    """Per station and track at the station's reported radius, and the track's bias against the station."""
    rows = found.join(reported, "station_id").where(is_close("radius_km", "reported_radius_km"))
    whole = rows.groupBy("station_id").agg(F.median(value).alias("station_median"))
    out = empirical(rows, ["station_id", "rgt"], value).join(rows.groupBy("station_id", "rgt").agg(F.countDistinct("date").alias("n_dates")), ["station_id", "rgt"]).join(whole, "station_id")
    return out.withColumns({"rgt_bias": F.col("median") - F.col("station_median"), "flag": low_sample()})


def uncertainty_table(found: DataFrame, ladder: DataFrame, reported: DataFrame, *, accuracy_m: float, few: int = FEW) -> DataFrame:
    """Per station: precision at the reported radius, and the parts of the systematic budget, each in its own column and never combined.

    Stations without a reported radius are rows with n 0. Spread over time is that of the medians of the three strategies."""
    rows = found.join(reported, "station_id").where(is_close("radius_km", "reported_radius_km"))
    medians = rows.groupBy("station_id").agg(*(F.median(f"c_{x}").alias(f"_{x}") for x in "abc"))
    out = reported.join(empirical(rows, ["station_id"], "c_a"), "station_id", "left").join(medians, "station_id", "left")
    spread = F.greatest("_a", "_b", "_c") - F.least("_a", "_b", "_c")
    text = {"sigma_gauge_zero_m": "not independently constrained", "sigma_egg2015_model_m": "unresolved (not inferred from these gauges)", "sigma_atl13_bias_m": "unresolved (see rgt_bias diagnostics)"}
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "temporal_spread": spread, "operation_accuracy_m": F.lit(accuracy_m), **{n: F.lit(t) for n, t in text.items()}})
    return corrector_uncertainty(out, ladder, few).drop("_a", "_b", "_c").withColumn("flag", low_sample(few=few))


def corrector_usage(points: DataFrame, station="station", value="c_station_m", km="station_km") -> DataFrame:
    """How many points take each station's corrector, and from how far."""
    return points.groupBy(station).agg(F.count("*").alias("n"), F.first(value).alias(value), F.avg(km).alias("mean_km"), F.max(km).alias("max_km"))


def worst(df: DataFrame, value: str, ties: list[str], n: int = 3) -> DataFrame:
    """The n rows of largest absolute value."""
    return df.where(finite(value).isNotNull()).orderBy(F.desc(F.abs(value)), *ties).limit(n)


def densest(passes: DataFrame, keys: list[str], n: str = "n_points") -> DataFrame:
    """The pass of most points of each group; of equals the last in the order of all columns."""
    rest = [c for c in passes.columns if c not in keys]
    return passes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(n, *[c for c in rest if c != n])).alias("_p")).select(*keys, "_p.*")


def all_radii(radii: Column, *more: float) -> Column:
    """The ladder's radii with some others, each once and in order."""
    return F.array_sort(F.array_union(radii, F.array(*(F.lit(float(r)) for r in more))))


def regimes_label(regimes: str | Column) -> Column:
    return F.array_join(regimes, "+")


def signed(value: str | Column, digits: int = 3) -> Column:
    """A number with its sign, for tables; null stays null."""
    return F.when(col(value).isNotNull(), F.format_string(f"%+.{digits}f", col(value).cast("double")))


def short_number(value: str | Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(value).cast("double")), r"0+$", ""), r"\.$", "")


def provisional(passes: DataFrame, daily: DataFrame, *, km: float, delta: float, period: str, value="h_bs77_m", level="median") -> DataFrame:
    """One row: the corrector of a post downstream from the passes within `km` in one period, against its daily series
    interpolated to the day of the pass and never beyond its ends. `passes` has station_km, `daily` date."""
    near = passes.where((F.col("period") == period) & (F.col("station_km") <= km)).withColumns({"_k": F.lit(1), "_day": F.date_trunc("day", F.col("datetime").cast("timestamp"))})
    series = daily.where(F.col("period") == period).select(F.lit(1).alias("_k"), F.col("date").cast("timestamp").alias("_day"), F.col(value).alias("value"))
    at = asof(near, series, key="_k", at="_day", ts="_day", max_gap_hours=None, ends="null").where("value is not null")
    return empirical(at.withColumn("c", F.col("value") + delta - F.col(level)), ["_k"], "c").drop("_k")
