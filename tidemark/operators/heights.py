"""Heights above the sea: from ellipsoidal heights and geoid grids to levels of water bodies of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, finite, in_polygon, period_label, truthy
from tidemark.operators.grids import Axis, sample_bilinear
from tidemark.operators.robust import basic_pass_levels, pass_levels
from tidemark.sources.regions import Region

#: Undulations beyond this are no data.
MOST_UNDULATION = 200.0
ALL = "ALL"


def above_quasigeoid(height: str | Column, zeta: str | Column) -> Column:
    return finite(height) - finite(zeta)


def datum_difference(egm2008: str | Column, evrs: str | Column) -> Column:
    """Small and smooth where the vertical chain is right."""
    return finite(egm2008) - finite(evrs)


def add_evrs(points: DataFrame, geoid: DataFrame, axis: Axis, *, height="h_wgs84_m", egm2008="H_egm2008_m") -> DataFrame:
    """Adds zeta_egg2015_m, H_evrs_egg2015_m and egm2008_minus_evrs_m; null outside the grid."""
    out = sample_bilinear(points, geoid, axis, "zeta_egg2015_m").withColumn("H_evrs_egg2015_m", above_quasigeoid(height, "zeta_egg2015_m"))
    return out.withColumn("egm2008_minus_evrs_m", datum_difference(egm2008, "H_evrs_egg2015_m"))


def add_heights(points: DataFrame, height: str, region: Region, *, geoid: tuple[DataFrame, Axis] | None = None, undulation: tuple[DataFrame, Axis] | None = None, egm2008: str | None = None, check: bool = True) -> DataFrame:
    """Adds N_m, H_m, H_egm2008_m and vertical_datum.

    EGM2008 heights come from the column `egm2008` if the points have it, else from the grid `undulation`. N is sampled in
    the grid `geoid` for egg2015 regions and the difference of the two heights for egm2008 ones. With `check` points that
    all lie outside the geoid grid raise an error, at the cost of one action; empty tables pass."""
    if egm2008 is not None and egm2008 in points.columns:
        out = points.withColumn("_egm", finite(egm2008))
    elif undulation is not None:
        n = F.when(F.abs("_u") <= MOST_UNDULATION, F.col("_u"))
        out = sample_bilinear(points, *undulation, "_u").withColumn("_egm", finite(height) - n).drop("_u")
    else:
        raise ValueError("EGM2008 heights need a column of the product or a grid of undulations")
    if region.vertical == "egg2015":
        if geoid is None:
            raise ValueError("egg2015 needs its grid")
        out = sample_bilinear(out, *geoid, "N_m")
        if check:
            rows, found = out.agg(F.count("*"), F.count("N_m")).first()
            if rows and not found:
                raise ValueError("all points lie outside the geoid grid; use egm2008 for this region")
    else:
        out = out.withColumn("N_m", finite(height) - F.col("_egm"))
    out = out.withColumns({"H_m": above_quasigeoid(height, "N_m"), "H_egm2008_m": F.col("_egm"), "vertical_datum": F.lit(region.datum)})
    return out.drop("_egm")


def to_heights(points: DataFrame, region: Region, product: str, height: str, *, geoid=None, undulation=None, last_before: str | None = None, first_after: str | None = None, time="time", check: bool = True) -> DataFrame:
    """Clip, heights and period. ATL13 keeps all rows with water_mask_pass and, for egg2015, the EVRS columns; other
    products lose the points outside. Regions without regimes have period ALL."""
    inside = in_polygon("lon", "lat", region.rings)
    if product == "ATL13":
        out = points.withColumn("water_mask_pass", F.coalesce(inside, F.lit(False)))
        out = add_evrs(out, *geoid, height=height) if region.vertical == "egg2015" and geoid else out
    else:
        out = points.where(inside)
    out = add_heights(out, height, region, geoid=geoid, undulation=undulation, egm2008="H_egm2008_m" if product == "ATL13" else None, check=check)
    return out.withColumn("period", period_label(time, last_before, first_after) if region.regimes else F.lit(ALL))


def levels_by_kind(points: DataFrame, region: Region, *, keys=("date", "rgt", "beam"), time="time", **columns) -> DataFrame:
    """Levels of passes in the region's datum: with full checks on still water, basic ones on rivers."""
    if region.still_water:
        out = pass_levels(points, keys=keys, height="H_m", time=time, on_water="water_mask_pass", **columns)
    else:
        out = basic_pass_levels(points, in_polygon("lon", "lat", region.rings), keys=keys, height="H_m", time=time)
    return out.withColumnsRenamed({"median": "median_wse_m", "mean": "mean_wse_m"}).withColumn("vertical_datum", F.lit(region.datum))


def dem_rows(points: DataFrame, product: str) -> DataFrame:
    """Points that enter comparisons with terrain models: on water only for ATL13."""
    return points.where(truthy("water_mask_pass")) if product == "ATL13" and "water_mask_pass" in points.columns else points


def add_water_mask(points: DataFrame, region: Region, masks: DataFrame | None = None, axis: Axis | None = None, *, date="date") -> DataFrame:
    """water_mask_pass: inside the area and, on dates with a mask, on a cell of water there; `masks` has date, iy, ix, water."""
    inside = F.coalesce(in_polygon("lon", "lat", region.rings), F.lit(False))
    if masks is None:
        return points.withColumn("water_mask_pass", inside)
    at = {"_iy": F.floor((col("lat") - axis.lat0) / axis.dlat + 0.5).cast("int"), "_ix": F.floor((col("lon") - axis.lon0) / axis.dlon + 0.5).cast("int")}
    days = masks.select(F.col("date").alias(date)).distinct().withColumn("_dated", F.lit(True))
    wet = masks.where("water > 0").select(F.col("date").alias(date), F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), F.lit(True).alias("_wet"))
    out = points.withColumns(at).join(days, date, "left").join(wet, [date, "_iy", "_ix"], "left")
    ok = inside & (F.col("_dated").isNull() | truthy("_wet"))
    return out.withColumn("water_mask_pass", ok).drop("_iy", "_ix", "_dated", "_wet")


def one_pass(points: DataFrame, **key) -> DataFrame:
    """The profile of one pass, from south to north."""
    for name, value in key.items():
        points = points.where(F.col(name) == value)
    return points.orderBy("lat", "lon")


def plausible_river_levels(passes: DataFrame, *, level="median", noise="nmad", most=3.0, most_noise=0.15, least_points=15) -> DataFrame:
    return passes.where((F.col(level) < most) & (F.col(noise) < most_noise) & (F.col("n_points") >= least_points))


def level_ranges(passes: DataFrame, by: str = "period", level: str = "median") -> DataFrame:
    """n, median, p05 and p95 of levels in each group."""
    return passes.groupBy(by).agg(F.count(level).alias("n"), F.median(level).alias("median"), F.percentile(level, 0.05).alias("p05"), F.percentile(level, 0.95).alias("p95"))
