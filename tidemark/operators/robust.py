"""Robust aggregation: medians and their deviations, exact percentiles, levels of passes, residual statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import MEDIAN_SE, NMAD, col, finite, haversine_km, reservoir_flags, transect, truthy


def with_deviation(df: DataFrame, keys: list[str], value: str, out: str = "_dev") -> DataFrame:
    """Adds each row's distance from its group's median. The window has exactly the later grouping keys, so both share one exchange."""
    return df.withColumn(out, F.abs(F.col(value) - F.median(value).over(Window.partitionBy(*keys))))


def spread_columns(value: str, dev: str = "_dev") -> dict[str, Column]:
    """Aggregates for a group of finite values and their deviations."""
    return {
        "n_points": F.count(value),
        "median": F.median(value),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "mad": F.median(dev),
        "nmad": NMAD * F.median(dev),
        "p05": F.percentile(value, 0.05),
        "p95": F.percentile(value, 0.95),
    }


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n_points, median, mean, std, mad, nmad, p05, p95 of the finite values of each group; null keys are a group."""
    df = with_deviation(df.withColumn("_v", finite(value)), keys, "_v")
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in spread_columns("_v").items()))
    return out.where("n_points > 0")


def track_slope(df: DataFrame, keys: list[str], lat: str, lon: str, height: str) -> DataFrame:
    """slope_m_per_km and length_km along each track, from its southernmost point.

    Fewer than three finite points give no slope; no point gives length null, one or more the distance to the
    northernmost; without length there is no slope."""
    good = df.select(*keys, finite(lat).alias("_lat"), finite(lon).alias("_lon"), finite(height).alias("_h")).where("_lat is not null and _lon is not null and _h is not null")
    w = Window.partitionBy(*keys)
    first = F.min(F.struct("_lat", "_lon")).over(w)
    good = good.withColumn("_a", first).withColumn("_d", haversine_km("_a._lat", "_a._lon", "_lat", "_lon"))
    out = good.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by("_d", F.struct("_lat", "_lon")).alias("length_km"), F.regr_slope("_h", "_d").alias("_s"))
    return out.select(*keys, "length_km", F.when((F.col("_n") >= 3) & (F.col("length_km") > 0), F.col("_s")).alias("slope_m_per_km"))


def pass_levels(points: DataFrame, *, keys=("date", "rgt", "beam"), height="height_m", time="time", lat="lat", lon="lon", noise="stdev", period="period", on_water="on_water") -> DataFrame:
    """One robust level for each pass of on-water points, with slope, length and quality flags.

    Statistics of heights take finite heights, means of place and noise all rows; null keys are kept; passes without a
    finite height go."""
    keys = list(keys)
    rows = points.where(truthy(on_water)).withColumn("_v", finite(height))
    w = Window.partitionBy(*keys)
    anchor = F.min(F.when(F.col("_v").isNotNull() & finite(lat).isNotNull() & finite(lon).isNotNull(), F.struct(finite(lat).alias("y"), finite(lon).alias("x")))).over(w)
    rows = with_deviation(rows, keys, "_v").withColumn("_a", anchor)
    rows = rows.withColumn("_d", F.when(F.col("_v").isNotNull(), haversine_km("_a.y", "_a.x", finite(lat), finite(lon))))
    out = rows.groupBy(*keys).agg(
        F.min(time).alias("datetime"),
        *(c.alias(n) for n, c in spread_columns("_v").items()),
        F.avg(noise).alias("mean_noise"), F.avg(lat).alias("lat_mean"), F.avg(lon).alias("lon_mean"),
        F.mode(period, True).alias("period"),
        F.max_by("_d", F.when(F.col("_d").isNotNull(), F.struct(finite(lat).alias("y"), finite(lon).alias("x")))).alias("track_length_km"),
        F.regr_slope("_v", "_d").alias("_slope"), F.count("_d").alias("_n"),
    ).where("n_points > 0")
    out = out.withColumns({"range_m": F.col("p95") - F.col("p05"), "slope_m_per_km": F.when((F.col("_n") >= 3) & (F.col("track_length_km") > 0), F.col("_slope"))})
    flags = reservoir_flags("n_points", "mad", "range_m", "track_length_km", "mean_noise", "slope_m_per_km")
    out = out.withColumn("qc_flags", flags).withColumn("qc_pass", F.col("qc_flags") == "")
    return out.drop("_slope", "_n")


def basic_pass_levels(points: DataFrame, inside: Column, *, keys=("date", "rgt", "beam"), height="height_m", time="time", lat="lat", lon="lon", period="period") -> DataFrame:
    """Levels of rivers: only finite heights inside the area count, for all columns; no slope and no flags. The period is that of the earliest row."""
    keys = list(keys)
    rows = points.withColumn("_v", finite(height)).where(F.col("_v").isNotNull() & F.coalesce(inside, F.lit(False)))
    stats = spread_columns("_v")
    del stats["std"]
    return with_deviation(rows, keys, "_v").groupBy(*keys).agg(F.min(time).alias("datetime"), *(c.alias(n) for n, c in stats.items()), F.avg(lat).alias("lat_mean"), F.avg(lon).alias("lon_mean"), F.min_by(period, F.struct(time, lat, lon)).alias("period"))


def named_transect(passes: DataFrame) -> DataFrame:
    return passes.withColumns({"transect": transect("rgt", "beam"), "year": F.year("date")})


def level_by_date(passes: DataFrame, level: str = "median", date: str = "date", ok: str = "qc_pass") -> DataFrame:
    return passes.where(truthy(ok)).groupBy(date).agg(F.median(level).alias("reservoir_level"))


def residual_stats(df: DataFrame, keys: list[str], residual: str) -> DataFrame:
    """n, bias, mae, rmse, std, nmad and the 95 % interval of the mean; groups without finite residuals have n 0 and nulls."""
    df = with_deviation(df.withColumn("_v", finite(residual)), keys, "_v")
    half = 1.96 * F.stddev_samp("_v") / F.sqrt(F.count("_v"))
    return df.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("bias"), F.avg(F.abs("_v")).alias("mae"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rmse"),
        F.stddev_samp("_v").alias("std"), (NMAD * F.median("_dev")).alias("nmad"), F.median("_v").alias("median"),
        (F.avg("_v") - half).alias("ci_low"), (F.avg("_v") + half).alias("ci_high"),
    )


def agreement(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, r2 and pearson; under three pairs, or without variance of y, no r2."""
    df = df.withColumns({"_x": finite(x), "_y": finite(y)})
    n = F.regr_count("_y", "_x")
    three = lambda c: F.when(n >= 3, c)
    return df.groupBy(*keys).agg(
        n.alias("n"), three(F.regr_slope("_y", "_x")).alias("slope"), three(F.regr_intercept("_y", "_x")).alias("intercept"),
        F.when((n >= 3) & (F.regr_syy("_y", "_x") > 0), F.regr_r2("_y", "_x")).alias("r2"), three(F.corr("_x", "_y")).alias("pearson"),
    )


def compare_heights(df: DataFrame, keys: list[str], height: str, reference: str, mask: Column | None = None) -> DataFrame:
    """Statistics of height minus reference over finite pairs."""
    d = finite(height) - finite(reference)
    df = df.withColumn("_v", d if mask is None else F.when(F.coalesce(mask, F.lit(False)), d))
    stats = {k: c for k, c in spread_columns("_v").items() if k != "mad"} | {"rmse": F.sqrt(F.avg(F.col("_v") * F.col("_v")))}
    return with_deviation(df, keys, "_v").groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items()))


def add_reference(df: DataFrame, refs: dict[str, DataFrame], sample) -> DataFrame:
    """For each reference: <name>_m, sampled only if absent, and dh_<name>_m. `sample(df, grid, out)` does the lookup."""
    for name, grid in refs.items():
        if f"{name}_m" not in df.columns:
            df = sample(df, grid, f"{name}_m")
        df = df.withColumn(f"dh_{name}_m", F.col("H_egm2008_m") - F.col(f"{name}_m"))
    return df


def with_all(df: DataFrame, outer: list[str], key: str, aggs: dict[str, Column], label: str = "ALL") -> DataFrame:
    """Groups by outer + key and by outer alone; the total's key is `label` and is_total tells it from a key of that name."""
    both = df.withColumn("_k", F.array(F.struct(F.col(key).cast("string").alias("k"), F.lit(False).alias("t")), F.struct(F.lit(label).alias("k"), F.lit(True).alias("t"))))
    both = both.withColumn("_k", F.explode("_k"))
    out = both.groupBy(*outer, F.col("_k.k").alias(key), F.col("_k.t").alias("is_total"))
    return out.agg(*(c.alias(n) for n, c in aggs.items()))


def matchup_summary(df: DataFrame, keys: list[str], value: str, rgt: str = "rgt", date: str = "date", few: int = 5) -> DataFrame:
    """n, dates, tracks, median, nmad, std and the interval median ± 1.96 · 1.2533 · nmad / sqrt(n), with a mark for few."""
    df = with_deviation(df.withColumn("_v", finite(value)), keys, "_v")
    n, nm = F.count("_v"), NMAD * F.median("_dev")
    half = F.when(n > 1, 1.96 * MEDIAN_SE * nm / F.sqrt(n))
    rgts = F.array_join(F.transform(F.array_sort(F.collect_set(rgt)), lambda v: v.cast("string")), ",")
    return df.groupBy(*keys).agg(n.alias("n"), F.countDistinct(date).alias("n_dates"), F.countDistinct(rgt).alias("n_rgts"), rgts.alias("rgts"), F.median("_v").alias("median"), nm.alias("nmad"), F.stddev_samp("_v").alias("std"), (F.median("_v") - half).alias("ci_low"), (F.median("_v") + half).alias("ci_high"), (n < few).alias("indicative"))


def coverage(df: DataFrame, keys: list[str], date: str, value: str, source: str, after: Column) -> DataFrame:
    """First and last date, counts, lists of years and sources, extremes, and the highest value under `after`."""
    years = F.array_join(F.transform(F.array_sort(F.collect_set(F.year(date))), lambda v: v.cast("string")), ",")
    return df.groupBy(*keys).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("n"), years.alias("years"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.bool_or(finite(value).isNotNull()).alias("any_value"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.when(after, col(value))).alias("high_after"))


def empirical_cdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("ecdf", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high]; the last bin holds its upper end."""
    at = F.least(F.floor((col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def spread_by(df: DataFrame, keys: list[str], value: str, n: str, few: int = 5) -> DataFrame:
    """Range of a value over the rows of each group with at least `few` counts; null with fewer than two such rows."""
    ok = df.where(F.col(n) >= few).groupBy(*keys).agg(F.count(value).alias("_n"), (F.max(value) - F.min(value)).alias("_s"))
    return ok.select(*keys, F.when(F.col("_n") > 1, F.col("_s")).alias("spread"))


def fixed_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """A sample of `n` rows that does not depend on partitions, for plots."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Means of a value with one column for each of `columns`; naming them saves a pass over the rows."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def flag_counts(df: DataFrame, flags: str = "qc_flags") -> DataFrame:
    """How often each of the flags joined by | occurs."""
    return df.select(F.explode(F.split(flags, r"\|")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def disagreeing(df: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """Rows of groups of two or more whose values span more than `most`."""
    bad = df.groupBy(*keys).agg(F.count(value).alias("_n"), (F.max(value) - F.min(value)).alias("_d")).where((F.col("_n") > 1) & (F.col("_d") > most))
    return df.join(bad, keys, "left_semi")


def gross_outliers(passes: DataFrame, noise: str = "nmad", spread: str = "range_m", *, most_noise: float = 0.30, most_range: float = 2.0, label: str = "gross") -> DataFrame:
    """Passes that are too noisy or too wide, with the reason."""
    return passes.where((F.col(noise) > most_noise) | (F.col(spread) > most_range)).withColumn("reason", F.lit(label))


def monthly(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def coverage_counts(df: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """Rows and good rows of each group, for an operator's overview."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(truthy(ok)).alias("n_ok"))


def recent_failures(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.where("status = 'failed'").orderBy(F.desc("finished_at"), "job_id").limit(n)
