"""Gauge files by path: per-station tables, term readings, yearbooks, yearly and versioned Parquet, and their daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite, period_label
from tidemark.operators.joins import first_per_key
from tidemark.operators.robust import union_all
from tidemark.sources.readers import STAGE_NAMES, TIME_NAMES, alias, conform, stitched, term_readings, versioned

# Local hours of the term readings, sources of a daily series by precedence, and its columns.
TERM_HOURS = {"h_08": 8, "h_20": 20}
SOURCES = ("yearbook_csv", "yearbook_grid", "donor_parquet", "donor_parquet_versioned")
SERIES = "date date, station_id string, slug string, name_en string, h_cm double, h_m_local double, h_bs77_m double, source string, period string, post_breach boolean"
SEPARATORS = (",", ";", "\t", "|")


def separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line of a text table has most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(SEPARATORS, key=line.count)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or text columns of a CSV file of any usual separator. Workbooks have to be saved as CSV first."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, sep=separator(spark, path))


def to_utc(local: Column, zone: str) -> Column:
    """A local time of a zone as UTC: times that the clock skips move to the end of the gap, times that it shows twice are null."""
    u = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    skipped = F.from_utc_timestamp(u, zone) != local
    twice = (F.from_utc_timestamp(u + hour, zone) == local) | (F.from_utc_timestamp(u - hour, zone) == local)
    return F.when(skipped, F.date_trunc("hour", u)).when(~twice, u)


def readings(raw: DataFrame, station: str) -> DataFrame:
    """(station_id, local, stage_raw) of a table whose columns go by many names; rows that do not read are dropped."""
    t, v = alias(raw, TIME_NAMES), alias(raw, STAGE_NAMES)
    out = raw.select(F.lit(station).alias("station_id"), F.try_to_timestamp(F.col(t).cast("string")).alias("local"), F.col(v).try_cast("double").alias("stage_raw"))
    return out.where("local is not null and stage_raw is not null and not isnan(stage_raw)")


def term_tables(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows of all stations under root/post_id=<id>/year=<y>.parquet in one scan; only post_id is a partition."""
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(f"{root}/post_id=*/year=*.parquet").withColumn("post_id", F.col("post_id").cast("string"))


def observations(rows: DataFrame, stations: DataFrame, *, zone: str = "UTC", scale: float = 1.0) -> DataFrame:
    """station_id, datetime (UTC), stage_m and WSE_baltic_m, one row a station and time, of readings (station_id, local, stage_raw).

    `stations` has station_id and zero_m, a table of configuration; unknown zeros give null levels."""
    out = rows.select("station_id", to_utc(F.col("local"), zone).alias("datetime"), (F.col("stage_raw") * scale).alias("stage_m")).where("datetime is not null")
    out = first_per_key(out, ["station_id", "datetime"], ["stage_m"]).join(F.broadcast(stations.select("station_id", "zero_m")), "station_id")
    return out.select("station_id", "datetime", "stage_m", (F.col("zero_m") + F.col("stage_m")).alias("WSE_baltic_m"))


def load_observations(spark: SparkSession, stations: DataFrame, *, root: str | None = None, files: dict[str, list[str]] | None = None, zone: str = "UTC", scale: float = 1.0) -> DataFrame:
    """Observations of all stations, from term readings under `root`, or from each station's `files`."""
    if root is not None:
        daily = term_tables(spark, root).withColumnRenamed("post_id", "station_id")
        rows = term_readings(daily, zone="UTC", hours=TERM_HOURS, scale=1.0).select("station_id", F.col("datetime").alias("local"), F.col("stage_m").alias("stage_raw"))
    else:
        rows = union_all(*(readings(read_table(spark, p), s) for s, paths in (files or {}).items() for p in paths))
    return observations(rows, stations, zone=zone, scale=scale)


def daily_means(daily: DataFrame, stations: DataFrame, *, zone: str = "UTC", scale: float = 0.01) -> DataFrame:
    """The daily mean at local noon, in the schema of observations()."""
    noon = F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + 12 * 3600)
    rows = daily.select("station_id", noon.alias("local"), F.col("h_mean").try_cast("double").alias("stage_raw")).where("stage_raw is not null")
    return observations(rows, stations, zone=zone, scale=scale)


def above_datum(h_cm: Column, zero: Column) -> Column:
    """Metres above the datum of centimetres above a gauge's zero; null where either is unknown."""
    return zero.cast("double") + h_cm / 100


def _source(df: DataFrame, h_cm: Column, local: Column, absolute: Column, name: str) -> DataFrame:
    day = F.coalesce(F.try_to_date(F.col("date").cast("string").substr(1, 10), "yyyy-MM-dd")) if dict(df.dtypes)["date"] != "date" else F.col("date")
    cast = lambda c, n: c.cast("double").alias(n)
    return df.select(day.alias("date"), cast(h_cm, "h_cm"), cast(local, "h_m_local"), cast(absolute, "h_bs77_m"), F.lit(name).alias("source")).where("date is not null")


def from_yearbook(table: DataFrame) -> DataFrame:
    """Daily rows of a yearbook table; its absolute heights stand as they are."""
    rows = table.where(F.col("stat_type") == "daily") if "stat_type" in table.columns else table
    number = lambda c: F.col(c).try_cast("double") if c in table.columns else F.lit(None)
    return _source(rows, number("water_level_cm"), number("water_level_m_abs"), number("water_level_m_abs"), "yearbook_csv")


def from_years(table: DataFrame, zero: float | None) -> DataFrame:
    """Yearly tables: the column h_mean if the table has it, else h_08; never a mixture by row."""
    name = next((c for c in ("h_mean", "h_08") if c in table.columns), None)
    if name is None:
        return table.sparkSession.createDataFrame([], "date date, h_cm double, h_m_local double, h_bs77_m double, source string")
    h = F.col(name).try_cast("double")
    return _source(table.where(h.isNotNull()), h, F.lit(None), above_datum(h, F.lit(zero)), "donor_parquet")


def from_versions(files: DataFrame, zero: float | None) -> DataFrame:
    """Versioned snapshots (see readers.versioned) of one post."""
    h = F.col("value").try_cast("double")
    return _source(versioned(files.where(h.isNotNull())), h, F.lit(None), above_datum(h, F.lit(zero)), "donor_parquet_versioned")


def read_versions(spark: SparkSession, root: str, post: str) -> DataFrame:
    """All snapshots of a post under root/<snapshot>/{daily,monthly}/post_id=<id>, with the path that versioned() ranks by."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    rows = rows.withColumn("path", F.replace(F.col("_metadata.file_path"), F.lit(root.rstrip("/")), F.lit("")))
    return rows.where(F.col("path").contains(f"/post_id={post}/")).withColumn("post_id", F.lit(post))


def downstream_series(parts: list[DataFrame], station: dict, *, last_before: str, first_after: str) -> DataFrame:
    """One row a date in the schema SERIES, from the first source in SOURCES that has it."""
    one = union_all(*parts).withColumns({"station_id": F.lit(str(station["id"])), "value": F.col("h_cm")})
    out = stitched(one, SOURCES, breach=last_before).drop("value")
    named = out.withColumns({"slug": F.lit(station.get("slug")), "name_en": F.lit(station.get("name_en")), "period": period_label("date", last_before, first_after)})
    from pyspark.sql.types import _parse_datatype_string

    return conform(named, _parse_datatype_string(SERIES))


def absolute_daily(series: DataFrame, zero: float) -> DataFrame:
    """Days with a finite absolute height, with the gauge's zero."""
    return series.where(finite("h_bs77_m").isNotNull()).select("date", "h_bs77_m", F.lit(float(zero)).alias("h0_bs77_m"), "period")
