"""Sources: granule lists and manifests, gauge series, yearbooks, text grids, regions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.exprs import granule_parts, masked, beam_label
from tidemark.operators.joins import first_per_key

# Names that gauge files use, in three languages, by precedence.
TIME_NAMES = ("datetime", "date", "timestamp", "time", "дата", "датачас")
STAGE_NAMES = ("stage", "level", "h", "h_mean", "рівень", "уровень", "hcm", "stage_cm")
SOURCE_ORDER = ("yearbook", "yearbook_grid", "reservoir", "versioned")


def granule_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text list: trimmed, without blanks and # comments, distinct."""
    t = spark.read.text(path).select(F.trim("value").alias("granule"))
    return t.where((F.col("granule") != "") & ~F.col("granule").startswith("#")).distinct()


def parsed(names: DataFrame, column: str = "granule") -> DataFrame:
    return names.withColumns(granule_parts(column))


def manifest(seed: DataFrame, found: DataFrame) -> DataFrame:
    """Union of two name lists with `source` seed, cmr or seed+cmr, parsed and ordered by acquisition."""
    a, b = (df.select("granule").distinct().withColumn(n, F.lit(True)) for df, n in ((seed, "_s"), (found, "_c")))
    both = a.join(b, "granule", "full")
    source = F.concat_ws("+", F.when(F.col("_s"), "seed"), F.when(F.col("_c"), "cmr"))
    return parsed(both.select("granule", source.alias("source"))).orderBy("acquired", "granule")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from CSV; release and version stay text."""
    return spark.read.csv(path, header=True, schema="granule string, source string, product string, acquired timestamp, rgt int, cycle int, region_no int, release string, version string")


def select_granules(names: DataFrame, *, start: str | None = None, end: str | None = None, product: str | None = None) -> DataFrame:
    """Parsed names of a product in an inclusive range of dates, oldest first; names that do not parse are left out."""
    out = parsed(names.select("granule").distinct()).where("acquired is not null")
    day = F.to_date("acquired")
    for cond, ok in ((start, day >= F.lit(start).cast("date")), (end, day <= F.lit(end).cast("date")), (product, F.col("product") == product)):
        if cond is not None:
            out = out.where(ok)
    return out.orderBy("acquired", "granule")


def normalised(raw: DataFrame, names: dict[str, str], schema: T.StructType, *, masks: tuple[str, ...] = (), track: str | None = "gt") -> DataFrame:
    """A raw frame in a fixed schema: renamed, sensor fills null, beam labelled, missing columns null, others dropped.

    Several raw columns may map to one name; the first that is not null counts."""
    made: dict[str, list[Column]] = {}
    for old, new in names.items():
        if old in raw.columns:
            made.setdefault(new, []).append(masked(old) if new in masks else F.col(old))
    if track and track in raw.columns:
        made["beam"] = [beam_label(track)]
    if "lon" not in made and "geometry_wkt" in raw.columns:
        wkt = r"POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)"
        made["lon"], made["lat"] = ([F.regexp_extract("geometry_wkt", wkt, i).try_cast("double")] for i in (1, 2))
    pick = lambda f: F.coalesce(*made[f.name]).cast(f.dataType) if f.name in made else F.lit(None).cast(f.dataType)
    return raw.select(*(pick(f).alias(f.name) for f in schema))


def seed_or_union(seed: DataFrame, *others: DataFrame, least: int = 50) -> DataFrame:
    """The seed list of names, or with fewer than `least` of them its union with the other lists."""
    names = seed.select("granule").distinct()
    if names.limit(least).count() >= least:
        return names
    for o in others:
        names = names.union(o.select("granule"))
    return names.distinct()


def candidate_granules(seed: DataFrame, remote: DataFrame, product: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Seed and remote names of a product in a range of dates, oldest first, each once."""
    return select_granules(seed.select("granule").union(remote.select("granule")), start=start, end=end, product=product)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """All batch files of a run; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def alias(df: DataFrame, names: tuple[str, ...]) -> str:
    """The column of `df` that goes by the first of `names`, whatever its case and blanks around it."""
    low = {c.lower().strip(): c for c in df.columns}
    for n in names:
        if n in low:
            return low[n]
    raise ValueError(f"no column like {', '.join(names)} among {', '.join(df.columns)}")


def gauge_series(raw: DataFrame, station: str, *, zone: str = "UTC", scale: float = 1.0, zero: float | None = None) -> DataFrame:
    """station_id, datetime (UTC), stage_m and wse_m from a table whose columns go by many names; rows that do not read are dropped."""
    t, v = alias(raw, TIME_NAMES), alias(raw, STAGE_NAMES)
    at = F.to_utc_timestamp(F.try_to_timestamp(F.col(t).cast("string")), zone)
    out = raw.select(F.lit(station).alias("station_id"), at.alias("datetime"), (F.col(v).try_cast("double") * scale).alias("stage_m"))
    return out.where("datetime is not null and stage_m is not null and not isnan(stage_m)").withColumn("wse_m", F.col("stage_m") + F.lit(zero).cast("double"))


def term_readings(daily: DataFrame, *, zone: str, hours: dict[str, int], scale: float = 0.01, fallback: str = "h_mean") -> DataFrame:
    """Columns of term readings, one local hour each, as rows; if none of them is there, the daily mean at noon."""
    have = {c: h for c, h in hours.items() if c in daily.columns} or {fallback: 12}
    long = daily.unpivot(["station_id", "date"], list(have), "term", "_v")
    hour = F.create_map(*(F.lit(x) for kv in have.items() for x in kv))[F.col("term")]
    local = F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + hour * 3600)
    out = long.select("station_id", F.to_utc_timestamp(local, zone).alias("datetime"), (F.col("_v").try_cast("double") * scale).alias("stage_m"))
    return first_per_key(out.where("stage_m is not null"), ["station_id", "datetime"], ["stage_m"])


def yearbook_grid(wide: DataFrame, year: int | Column, months: list[str], day: str = "day") -> DataFrame:
    """A table of days by months as (date, value), of one year or with a column for it; days that a month does not have are dropped."""
    long = wide.unpivot([c for c in wide.columns if c not in months], months, "_m", "value").withColumn("_m", F.regexp_extract("_m", r"(\d+)", 1).cast("int"))
    y = F.lit(year) if isinstance(year, int) else year
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), F.col("_m"), F.col(day).cast("int"))
    return long.select(F.try_to_date(text, "yyyy-MM-dd").alias("date"), F.col("value").try_cast("double").alias("value")).where("date is not null and value is not null")


def versioned(files: DataFrame) -> DataFrame:
    """Level rows with `path`: daily outranks monthly for a post altogether; of one date a snapshot that is not tmp_ counts."""
    rows = files.where("variable = 'level'").withColumns({"_tmp": F.col("path").rlike(r"/tmp_"), "_monthly": F.col("path").rlike("/monthly/")})
    least = F.min("_monthly").over(Window.partitionBy("post_id"))
    rows = rows.withColumn("_least", least).where(F.col("_monthly") == F.col("_least"))
    return first_per_key(rows, ["post_id", "date"], ["_tmp", "path"]).drop("_tmp", "_monthly", "_least")


def stitched(series: DataFrame, order: tuple[str, ...] = SOURCE_ORDER, *, keys=("station_id", "date"), breach: str | None = None) -> DataFrame:
    """One row a station and date, from the first source in `order`; then unknown sources."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in order)), F.col("source")), F.lit(0))
    out = first_per_key(series.withColumn("_p", F.when(rank == 0, len(order) + 1).otherwise(rank)), list(keys), ["_p", "source", "value"]).drop("_p")
    return out if breach is None else out.withColumn("post_breach", F.col("date") >= F.lit(breach).cast("date"))


def open_water(passes: DataFrame) -> DataFrame:
    """Plausible levels of open water."""
    return passes.where("nmad < 0.20 and n_points >= 15 and abs(median) < 3")


def station_correctors(table: DataFrame) -> DataFrame:
    out = table.where("c_station_m is not null and not isnan(c_station_m)").withColumnRenamed("empirical_nmad_m", "sigma_m")
    if out.isEmpty():
        raise ValueError("no station has a corrector")
    return out


def polygon_of(geojson: str) -> list[list[tuple[float, float]]]:
    """Rings of a polygon, multipolygon, feature or collection."""
    g = json.loads(geojson)
    if g["type"] == "FeatureCollection":
        return [r for f in g["features"] for r in polygon_of(json.dumps(f))]
    if g["type"] == "Feature":
        g = g["geometry"]
    many = g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]
    return [[(float(p[0]), float(p[1])) for p in ring] for poly in many for ring in poly]


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed counter-clockwise hull."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return [*pts, *pts[:1]]

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(reversed(pts))
    return [*ring, ring[0]]


def region_registry(*tables: DataFrame) -> DataFrame:
    """Regions by slug from tables in order of precedence."""
    ranked = [t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_per_key(out, ["slug"], ["_p"]).drop("_p")


def region_errors(regions: DataFrame) -> DataFrame:
    """(slug, error) of each broken rule: kind, vertical, an area, and a box in order."""
    rules = F.array(
        F.when(~F.coalesce(F.col("kind").isin("reservoir", "lake", "river"), F.lit(False)), "kind"),
        F.when(~F.coalesce(F.col("vertical").isin("egm2008", "egg2015"), F.lit(False)), "vertical"),
        F.when(F.col("bbox").isNull() & F.col("polygon").isNull(), "area"),
        F.when(F.col("bbox").isNotNull() & ((F.size("bbox") != 4) | (F.get("bbox", 0) >= F.get("bbox", 2)) | (F.get("bbox", 1) >= F.get("bbox", 3))), "bbox"),
    )
    return regions.select("slug", F.explode(F.array_compact(rules)).alias("error"))


def parse_esri(text: str) -> Iterator[tuple[int, int, float, float, float | None]]:
    """Nodes of an ESRI ASCII grid, south first; cell corners are moved to centres."""
    head, rows = {}, text.split("\n")
    while rows and rows[0].split() and rows[0].split()[0][0].isalpha():
        k, v = rows.pop(0).split()[:2]
        head[k.lower()] = float(v)
    ny, nx = int(head["nrows"]), int(head["ncols"])
    dx, dy = head.get("dx", head.get("cellsize")), head.get("dy", head.get("cellsize"))
    x0 = head["xllcenter"] if "xllcenter" in head else head["xllcorner"] + dx / 2
    y0 = head["yllcenter"] if "yllcenter" in head else head["yllcorner"] + dy / 2
    values = " ".join(rows).split()
    for i, v in enumerate(values[: ny * nx]):
        iy, ix = ny - 1 - i // nx, i % nx
        yield iy, ix, y0 + iy * dy, x0 + ix * dx, None if float(v) == head.get("nodata_value") else float(v)


def _degrees(text: str) -> float:
    t = text.strip().replace("°", " ").replace("'", " ").replace('"', " ").split()
    sign = -1 if t[0].startswith("-") else 1
    return sign * sum(abs(float(x)) / 60**i for i, x in enumerate(t))


def parse_isg(text: str) -> Iterator[tuple[int, int, float, float, float | None]]:
    """Nodes of an ISG text grid whose rows run from north to south, with decimal or sexagesimal bounds."""
    head, _, body = text.partition("end_of_head")
    items = dict((a.strip().lower(), b.strip()) for a, _, b in (x.replace("=", ":", 1).partition(":") for x in head.split("\n")) if b)
    lat0, lat1, lon0, lon1 = (_degrees(items[k]) for k in ("lat min", "lat max", "lon min", "lon max"))
    ny, nx = int(items["nrows"]), int(items["ncols"])
    dy, dx = _degrees(items["delta lat"]), _degrees(items["delta lon"])
    edge = abs((lat1 - lat0) - ny * dy) < abs((lat1 - lat0) - (ny - 1) * dy)
    values = body.partition("\n")[2].split()
    for i, v in enumerate(values[: ny * nx]):
        iy, ix = ny - 1 - i // nx, i % nx
        yield iy, ix, lat0 + (iy + (0.5 if edge else 0)) * dy, lon0 + (ix + (0.5 if edge else 0)) * dx, None if float(v) == float(items.get("nodata", "-9999")) else float(v)


GRID_SCHEMA = "file string, iy int, ix int, lat double, lon double, value double"


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """ESRI and ISG text grids of any file system that Spark reads, one task a file; the kind is told by the head."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def nodes(frames):
        import pandas as pd

        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                rows = list((parse_isg if "end_of_head" in text else parse_esri)(text))
                yield pd.DataFrame([(p.rsplit("/", 1)[-1], *r) for r in rows], columns=[c.split(" ")[0] for c in GRID_SCHEMA.split(", ")])

    return files.mapInPandas(nodes, GRID_SCHEMA)


class GranuleBatches(DataSource):
    """A batch source with one partition for each batch of granules; `fetcher` names a function module:function that returns rows for a list of names. Without network it serves replays and tests."""

    @classmethod
    def name(cls) -> str:
        return "granules"

    def schema(self) -> str:
        return self.options.get("schema", "granule string, rgt int, cycle int, time timestamp, lat double, lon double, height double")

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)


class _Batch(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.names = [x for x in options.get("names", "").split(",") if x]
        self.size, self.fetcher = int(options.get("batch", "50")), options["fetcher"]

    def partitions(self):
        return [_Batch(self.names[i : i + self.size]) for i in range(0, len(self.names), self.size)] or [_Batch([])]

    def read(self, partition):
        import importlib

        module, _, name = self.fetcher.partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.names)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
