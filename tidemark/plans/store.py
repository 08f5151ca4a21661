"""Tables on a shared file system: layout, keyed merges into partitions, granule and job bookkeeping, reads of the service."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import first_per_key, merged

# Natural keys.
KEYS = {
    "points": ["region", "beam", "time"],
    "passes": ["region", "date", "rgt", "beam"],
    "granules": ["region", "product", "granule"],
    "dem_comparisons": ["job_id", "dem"],
    "rasters": ["job_id", "variable", "resolution_m"],
    "regions": ["slug"],
}


#: Versions of a table that stay.
KEPT = 3


@dataclass(frozen=True)
class Layout:
    """Where a run keeps its files."""

    root: str
    product: str
    version: str
    region: str

    def path(self, kind: str, run: str | None = None) -> str:
        base = f"{self.root.rstrip('/')}/{self.product}/v{self.version}/{self.region}/{kind}"
        return base if run is None else f"{base}/run={run}"


class Store:
    """Tables as Parquet versions: a merge writes a new version beside the old one; the newest whole version counts, so a
    crash leaves the old one in place and a replay gives the same table. The last KEPT versions stay for readers that began before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _versions(self, table: str) -> list[str]:
        """Whole versions, oldest first."""
        fs = self._fs()
        if not fs.exists(self._path(table)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(table)) if fs.exists(self._path(table, s.getPath().getName(), "_SUCCESS")))

    def _current(self, table: str) -> str | None:
        return (self._versions(table) or [None])[-1]

    def read(self, table: str) -> DataFrame | None:
        now = self._current(table)
        return None if now is None else self.spark.read.parquet(f"{self.root}/{table}/{now}")

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        now = self._current(table)
        name = f"{int(now.split('-')[0]) + 1 if now else 0:012d}-{uuid.uuid4().hex[:8]}"
        w = df.write.mode("errorifexists")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{table}/{name}")
        for old in self._versions(table)[:-KEPT]:
            self._fs().delete(self._path(table, old), True)

    def merge(self, table: str, new: DataFrame, keys: list[str] | None = None, *, keep_old_if_null: tuple[str, ...] = (), guard: Column | None = None, order: list | None = None, partition_by: tuple[str, ...] = ()) -> None:
        """Upsert by key; of several new rows with one key the first in `order` counts. Running it twice changes nothing."""
        keys = keys or KEYS[table]
        new = first_per_key(new, keys, order or [F.xxhash64(*new.columns)])
        old = self.read(table)
        self.write(table, new if old is None else merged(old, new, keys, keep_old_if_null=keep_old_if_null, guard=guard), partition_by)

    def replace(self, table: str, new: DataFrame, keys: list[str]) -> None:
        """Delete the old rows of the new rows' keys, then insert."""
        old = self.read(table)
        self.write(table, new if old is None else old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new))


def upsert_region(store: Store, region: DataFrame) -> None:
    """Only the owner, null included, may change a region."""
    store.merge("regions", region, guard=F.col("o.owner").eqNullSafe(F.col("n.owner")))


def set_granules(store: Store, rows: DataFrame) -> None:
    """Status of granules; rows and archive path stay where the new ones are null."""
    store.merge("granules", rows, keep_old_if_null=("n_rows", "raw_uri"))


def latest_jobs(events: DataFrame) -> DataFrame:
    """State of each job from its log of (job_id, at, status, stage, stats): first start, last end, stats merged in order."""
    w = F.struct("at", "seq")
    none = F.create_map().cast("map<string,string>")
    patches = F.array_sort(F.collect_list(F.struct("at", "seq", F.to_json("stats").alias("stats"))))  # maps have no order, so they wait as text
    later = lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(x, k)), x)
    folded = F.aggregate(patches, none, lambda a, p: later(a, F.coalesce(F.from_json(p["stats"], "map<string,string>"), none)))
    return events.groupBy("job_id").agg(
        F.min("at").alias("created_at"), F.max_by("status", w).alias("status"), F.max_by("stage", F.when(F.col("stage").isNotNull(), w)).alias("stage"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status").isin("done", "failed"), F.col("at"))).alias("finished_at"), folded.alias("stats"),
    )


def filtered(df: DataFrame, *, equal: dict | None = None, day: str | None = None, start: str | None = None, end: str | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
    """The service's reads: optional equalities, an inclusive range of days, an order and a limit. The range is put on the
    column itself, so files and partitions can be skipped."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(day) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)


def lines_of_passes(points: DataFrame, keys: list[str], *, time="time", lon="lon", lat="lat") -> DataFrame:
    """A line for each pass of at least two points, ordered by time, as array and as WKT."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(time, lon, lat))), lambda p: F.struct(p[lon].alias("lon"), p[lat].alias("lat")))
    out = points.groupBy(*keys).agg(line.alias("line")).where(F.size("line") > 1)
    return out.withColumn("wkt", F.concat(F.lit("LINESTRING("), F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")")))


def feature_rows(passes: DataFrame, properties: list[str], *, lon="lon_mean", lat="lat_mean", line: str | None = None) -> DataFrame:
    """A GeoJSON feature for each pass, with its line or else its mean point."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    geometry = point if line is None else F.coalesce(F.to_json(F.when(F.col(line).isNotNull(), F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))), point)
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    return passes.select(*properties, text.alias("feature"))


def feature_collection(features: DataFrame, order: str) -> DataFrame:
    """One JSON document, for the bounded answers of a service; write the features themselves as JSON lines for more."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda x: x["feature"])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(items, ","), F.lit("]}")).alias("document"))


def counts_by_region(**tables: DataFrame) -> DataFrame:
    out = None
    for name, t in tables.items():
        one = t.groupBy("region").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("region").pivot("table", sorted(tables)).agg(F.sum("n")).na.fill(0)


def with_lines(passes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Passes with the line of their points; passes of under two points have none."""
    return passes.join(lines_of_passes(points, keys), keys, "left")


def job_statistics(points: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """One row: points, water_segments, and of passes their number and how many are good."""
    out = points.agg(F.count("*").alias("points"), F.count_if(F.coalesce("water_mask_pass", F.lit(False))).alias("water_segments"))
    if passes is not None:
        ok = F.count_if(F.coalesce("qc_pass", F.lit(False))).alias("pass_levels_qc")
        out = out.crossJoin(passes.agg(F.count("*").alias("pass_levels"), ok))  # one row each
    return out


def rows_by_granule(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """How many rows each granule gave, none included; `lookup` has granule, rgt and cycle."""
    n = points.groupBy("rgt", "cycle").agg(F.count("*").alias("n_rows"))
    return lookup.join(n, ["rgt", "cycle"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def spans(df: DataFrame, keys: list[str], date: str, **distinct: str) -> DataFrame:
    """Rows, first and last date, and distinct counts n_<name> of columns in each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), *(F.countDistinct(c).alias(f"n_{n}") for n, c in distinct.items()))


def raster_metadata(stations: DataFrame, value: str, **tags: str) -> DataFrame:
    """One row of tags of a raster: what the caller names, and number, least and largest of the stations' values."""
    return stations.agg(F.count(value).alias("n_stations"), F.min(value).alias("min_m"), F.max(value).alias("max_m")).withColumns({k: F.lit(v) for k, v in tags.items()})


def mapped(df: DataFrame, column: str, table: dict, default=None, out: str | None = None) -> DataFrame:
    """A column by a small table of configuration; what the table lacks has the default."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return df.withColumn(out or column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(default)))


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema for a load: text is cast or becomes null, NaN becomes null, columns that are missing are null."""
    from pyspark.sql.types import _parse_datatype_string

    def one(f):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType)
        c = F.col(f.name).try_cast(f.dataType)
        return F.when(~F.isnan(c), c) if f.dataType.simpleString() in ("double", "float") else c

    return df.select(*(one(f).alias(f.name) for f in _parse_datatype_string(schema)))


def checked_samples(grid_nearest: DataFrame, source: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values read back from an export against those of its source at the same stations: difference and whether it holds."""
    out = grid_nearest.select(*keys, F.col(value).alias("exported")).join(source.select(*keys, F.col(value).alias("original")), keys, "full")
    d = F.abs(F.col("exported") - F.col("original"))
    return out.withColumns({"difference": d, "ok": F.coalesce(d <= tolerance, F.col("exported").isNull() & F.col("original").isNull())})
