"""Products, parameters of remote requests, and the rules of a job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.sources.regions import Region, request_ring


@dataclass(frozen=True)
class Product:
    name: str
    version: str
    height: str  # column of ellipsoidal heights
    batch: int  # granules of one request
    needs_coord: bool
    stored_points: bool
    rasters: dict[str, str]  # variable: column


# Products of the mission and classes of its photons.
PRODUCTS = {p.name: p for p in (
    Product("ATL13", "007", "h_wgs84_m", 50, True, True, {"wse": "H_m"}),
    Product("ATL08", "007", "h_te_median_m", 10, False, True, {"dtm": "H_m", "chm": "h_canopy_m"}),
    Product("ATL03", "007", "height_m", 3, False, False, {"dtm": "H_m"}),
)}
CLASSES = ("atl08_noise", "atl08_ground", "atl08_canopy", "atl08_top_of_canopy", "atl08_unclassified")
CONFIDENCE = 4


def product(name: str) -> Product:
    if name.upper() not in PRODUCTS:
        raise KeyError(f"unknown product {name!r}; there are {', '.join(sorted(PRODUCTS))}")
    return PRODUCTS[name.upper()]


def products_table(spark) -> DataFrame:
    """Name, version, height column, batch size and raster variables of each product."""
    rows = [(p.name, p.version, p.height, p.batch, p.needs_coord, p.stored_points, sorted(p.rasters)) for p in PRODUCTS.values()]
    return spark.createDataFrame(rows, "product string, version string, height string, batch int, needs_coord boolean, stored_points boolean, rasters array<string>")


def unknown_classes(options: dict) -> list[str]:
    return sorted(set(options.get("atl08_class") or ()) - set(CLASSES))


def request_parameters(p: Product, region: Region, granules: list[str], photons: dict | None = None) -> dict:
    """What one request for `granules` asks for: by the water body's point, or by a ring around the area."""
    if p.needs_coord:
        if region.coord is None:
            raise ValueError(f"{p.name} needs a point on the water body")
        body = {"coord": {"lon": region.coord[0], "lat": region.coord[1]}} | ({} if region.refid is None else {"refid": region.refid})
        return {"atl13": body, "resources": list(granules)}
    out = {"poly": request_ring(region.rings), "locks": 1, "resources": list(granules)}
    if p.name == "ATL03":
        photons = photons or {}
        if bad := unknown_classes(photons):
            raise ValueError(f"unknown classes {', '.join(bad)}; there are {', '.join(CLASSES)}")
        out["cnf"] = int(photons.get("cnf", CONFIDENCE))
        if photons.get("atl08_class"):
            out["atl08_class"] = list(photons["atl08_class"])
    return out


def request_batches(names: DataFrame, done: DataFrame, p: Product, *, limit: int | None = None, size: int | None = None) -> DataFrame:
    """granule, acquired, batch: the oldest `limit` granules that are not done, dealt into requests in order.

    With a limit its rows are numbered in one task; without, all granules are, by ranges of time."""
    rows = names.join(done.where(F.col("status").isin("loaded", "empty")).select("granule"), "granule", "left_anti")
    if limit is None:
        rows = numbered(rows, ["acquired", "granule"], "_n")
    else:
        rows = rows.orderBy("acquired", "granule").limit(limit).withColumn("_n", F.row_number().over(Window.orderBy("acquired", "granule")))
    return rows.withColumn("batch", F.floor((F.col("_n") - 1) / (size or p.batch)).cast("int")).drop("_n")


def job_errors(request: dict) -> list[str]:
    """What is wrong with a job request, in words."""
    name, region, dem, photons = request.get("product", "ATL13"), request.get("region"), request.get("dem") or {}, request.get("atl03")
    rules = [
        (name not in PRODUCTS, f"unknown product {name}"),
        ((request.get("region_slug") is None) == (region is None), "exactly one of region_slug and region"),
        (bool(request.get("start") and request.get("end") and request["start"] > request["end"]), "start after end"),
        (request.get("limit") is not None and request["limit"] < 1, "limit under 1"),
        (request.get("batch_size") is not None and not 1 <= request["batch_size"] <= 200, "batch_size outside 1 to 200"),
        (photons is not None and name != "ATL03", "atl03 options belong to ATL03"),
        (bool(unknown_classes(photons or {})), f"unknown classes {', '.join(unknown_classes(photons or {}))}"),
        (bool(set(request.get("compare") or ()) - {"cop30", "fabdem"}), "compare with cop30 or fabdem"),
        (dem.get("resolution_m") is not None and not 10 <= dem["resolution_m"] <= 10_000, "resolution_m outside 10 to 10000"),
        (name in PRODUCTS and bool(set(dem.get("variables") or ()) - set(PRODUCTS[name].rasters)), "unknown raster variables"),
        (name == "ATL13" and region is not None and not region.get("coord"), "ATL13 needs region.coord"),
    ]
    return [text for broken, text in rules if broken]


def job_table_errors(jobs: DataFrame) -> DataFrame:
    """(job_id, error) of each broken rule over a table of requests: product, region_slug, has_region, has_coord, start, end,
    batch_size, classes, variables (arrays)."""
    known = F.create_map(*(x for p in PRODUCTS.values() for x in (F.lit(p.name), F.array(*map(F.lit, sorted(p.rasters))))))
    of = F.col("product")
    rules = {
        "product": ~of.isin(*PRODUCTS), "region": F.col("region_slug").isNotNull() == F.col("has_region"), "dates": F.col("start") > F.col("end"),
        "batch_size": ~F.col("batch_size").between(1, 200), "atl03": F.col("classes").isNotNull() & (of != "ATL03"),
        "classes": F.size(F.array_except("classes", F.array(*map(F.lit, CLASSES)))) > 0, "variables": F.size(F.array_except("variables", F.try_element_at(known, of))) > 0,
        "coord": (of == "ATL13") & F.col("has_region") & ~F.col("has_coord"),
    }
    return jobs.select("job_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("error"))
