"""Exact quantiles of groups of any size, by refinement of histograms.

`percentile` and `median` hold all values of a group in one task. Here a group's values stay where they are: a round
counts them in BINS bins between bounds that are values themselves, finds the bin that holds the wanted rank, and takes
its least and greatest value as the next bounds. All groups and quantiles are refined at once; a task sends a row for
each bin, whatever it holds. Bins are equal in width, or in width of the logarithm where the bounds differ in size, so a
round divides a range of 64 bits by about 1,024 and there are eight rounds at most for any values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import NMAD, finite
from tidemark.plans.cut import cut

#: Groups of more rows are refined; smaller ones are left to `percentile`.
HOT_ROWS = 1_000_000
BINS = 1024
#: A bin of so many values is gathered and sorted; it fits any task.
FEW = 5000
#: Tables of bounds go to all executors up to so many rows, counted.
SMALL_ROWS = 10_000


def _scaled(v: Column) -> Column:
    """The logarithm of the size, with the sign, as a monotone function of v: 746 is beyond the smallest double's."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v, monotone in v: 0 for lo, BINS - 1 for hi."""
    flat = ((lo > 0) & (hi / 4 <= lo)) | ((hi < 0) & (lo / 4 >= hi))
    at = lambda f: F.try_divide(f(v) - f(lo), f(hi) - f(lo))
    share = F.when(flat, at(lambda x: x)).otherwise(at(_scaled))
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS))).cast("int")


def _between(low: Column, high: Column, pos: Column) -> Column:
    """What lies at a fractional rank, in the words of Spark's percentile."""
    return F.when((F.floor(pos) == F.ceil(pos)) | (low == high), low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)


def refined(rows: DataFrame, qs: list[float], *, bins_per_round: int = BINS) -> DataFrame:
    """(_g, q, value): exact quantiles of `rows` (_g: a struct of keys, _v: finite doubles), all groups refined at once."""
    size = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    now = cut(size.withColumn("q", F.explode(F.lit([float(q) for q in qs]))).withColumns({"pos": (F.col("n") - 1) * F.col("q"), "below": F.lit(0).cast("long")}))
    done = []
    while True:
        flat = now.where("lo = hi")
        done.append(flat.select("_g", "q", F.col("lo").alias("value")))
        few = now.where(f"lo < hi and n <= {FEW}")
        last = _at_bounds(rows, few).groupBy("_g", "q", "pos", "below").agg(F.sort_array(F.collect_list("_v")).alias("x"))
        pick = lambda f: F.element_at("x", (f("pos") - F.col("below") + 1).cast("int"))
        done.append(last.select("_g", "q", _between(pick(F.floor), pick(F.ceil), F.col("pos")).alias("value")))
        wide = now.where(f"lo < hi and n > {FEW}")
        if wide.isEmpty():
            break
        b = _at_bounds(rows, wide).groupBy("_g", "q", "pos", "below", _bin(F.col("_v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("_g", "q").orderBy("bin"))  # BINS rows at most
        b = b.withColumn("from", F.col("below") + upto - F.col("c")).withColumn("to", F.col("from") + F.col("c"))
        low, high = F.floor("pos"), F.ceil("pos")
        b = b.withColumns({"has_low": (F.col("from") <= low) & (low < F.col("to")), "has_high": (F.col("from") <= high) & (high < F.col("to"))}).where("has_low or has_high")
        b = cut(b)
        split = b.where("has_low != has_high").groupBy("_g", "q", "pos").agg(F.max(F.when(F.col("has_low"), F.col("hi"))).alias("a"), F.max(F.when(F.col("has_high"), F.col("lo"))).alias("b"))
        done.append(split.select("_g", "q", _between(F.col("a"), F.col("b"), F.col("pos")).alias("value")))
        now = b.where("has_low and has_high").select("_g", F.col("c").alias("n"), "lo", "hi", "q", "pos", F.col("from").alias("below"))
    return reduce(DataFrame.unionByName, done)


def _at_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows within each bound of their group."""
    b = bounds.select(F.col("_g").alias("_g2"), "q", "pos", "below", "lo", "hi")
    b = F.broadcast(b) if bounds.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else b
    return rows.join(b, (F.col("_g") == F.col("_g2")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_g2")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each group that has finite values, with its exact quantiles by name, as `percentile` gives them.

    Groups of more than `hot_rows` values are refined, the others aggregated; null keys are a group, no keys are one
    group of all rows."""
    rows = df.select(F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_")).alias("_g"), finite(value).alias("_v")).where("_v is not null")
    hot = cut(rows.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select("_g"))
    n_hot = hot.limit(SMALL_ROWS + 1).count()
    small = F.broadcast(hot) if n_hot <= SMALL_ROWS else hot
    cold = rows if n_hot == 0 else rows.join(small, "_g", "left_anti")
    out = cold.groupBy("_g").agg(*(F.percentile("_v", q).alias(name) for name, q in qs.items()))
    if n_hot:
        found = refined(rows.join(small, "_g", "left_semi"), sorted(set(qs.values())))
        out = out.unionByName(found.groupBy("_g").agg(*(F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name) for name, q in qs.items())))
    return out.select(*(F.col("_g")[k].alias(k) for k in keys), *qs)


def quantiles_with_total(df: DataFrame, outer: list[str], key: str, value: str, qs: dict[str, float], *, label: str = "ALL", hot_rows: int = HOT_ROWS) -> DataFrame:
    """n (all rows) and quantiles() by outer + key, and by outer alone as the row `label` with is_total; groups without finite values have nulls."""
    both = df.select(*outer, F.explode(F.array(F.struct(F.col(key).cast("string").alias("k"), F.lit(False).alias("t")), F.struct(F.lit(label).alias("k"), F.lit(True).alias("t")))).alias("_k"), F.col(value).alias("_v"))
    both = both.select(*outer, F.col("_k.k").alias(key), F.col("_k.t").alias("is_total"), "_v")
    keys = [*outer, key, "is_total"]
    n = both.groupBy(*keys).agg(F.count("*").alias("n"))
    found = quantiles(both, keys, "_v", qs, hot_rows=hot_rows).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = n.join(found, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    return out.select(*keys, "n", *qs)


def robust_stats_any(df: DataFrame, keys: list[str], value: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """robust_stats() for groups of any size: the MAD is a second selection, over distances from the first one's median."""
    df = df.withColumn("_v", finite(value)).where("_v is not null")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(b[f"_{k}"]) for k in keys], F.lit(True))
    first = cut(quantiles(df, keys, "_v", {"median": 0.5, "p05": 0.05, "p95": 0.95}, hot_rows=hot_rows))
    alias = lambda t, *more: t.select(*(F.col(k).alias(f"_{k}") for k in keys), *more)
    m = alias(first, F.col("median").alias("_m"))
    few = first.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    m = F.broadcast(m) if few else m
    away = df.join(m, same(df, m)).withColumn("_dev", F.abs(F.col("_v") - F.col("_m"))).select(*keys, "_dev")
    mad = quantiles(away, keys, "_dev", {"mad": 0.5}, hot_rows=hot_rows)
    plain = df.groupBy(*keys).agg(F.count("*").alias("n_points"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    d = alias(mad, "mad")
    p = alias(plain, "n_points", "mean", "std")
    out = first.join(d, same(first, d)).select(*keys, "median", "p05", "p95", "mad")
    out = out.join(p, same(out, p))
    return out.select(*keys, "n_points", "median", "mean", "std", "mad", (NMAD * F.col("mad")).alias("nmad"), "p05", "p95")


def robust_stats_with_total(df: DataFrame, outer: list[str], key: str, value: str, *, label: str = "ALL", hot_rows: int = HOT_ROWS) -> DataFrame:
    """robust_stats_any() by outer + key, and by outer alone as the row `label` with is_total; rows are not doubled."""
    parts = robust_stats_any(df.withColumn(key, F.col(key).cast("string")), [*outer, key], value, hot_rows=hot_rows).withColumn("is_total", F.lit(False))
    total = robust_stats_any(df, outer, value, hot_rows=hot_rows).withColumns({key: F.lit(label), "is_total": F.lit(True)})
    return parts.unionByName(total)
