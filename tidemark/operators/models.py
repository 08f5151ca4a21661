"""Spatial models over a few control points, their cross-validation, and the bootstrap of a median.

Groups here are stations, tens at most; fits run in applyInPandas, one group a call."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_A, _FLAT = 6378137.0, 1 / 298.257223563
MODELS = ("constant", "plane", "idw_p1", "idw_p2", "linear")


def geodesic(lat1, lon1, lat2, lon2) -> tuple[float, float]:
    """Distance in metres and azimuth in radians on the ellipsoid, by Vincenty's inverse formula."""
    if lat1 == lat2 and lon1 == lon2:
        return 0.0, 0.0
    b = _A * (1 - _FLAT)
    u1, u2 = (np.arctan((1 - _FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    d = lam = np.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        s = np.arctan2(sin_s, cos_s)
        sin_a = np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s
        cos2a = 1 - sin_a**2
        mid = cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2a if cos2a > 1e-15 else 0.0
        c = _FLAT / 16 * cos2a * (4 + _FLAT * (4 - 3 * cos2a))
        new = d + (1 - c) * _FLAT * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(new - lam) < 1e-13:
            lam = new
            break
        lam = new
    k = cos2a * (_A**2 - b**2) / b**2
    p = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    q = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    fix = q * sin_s * (mid + q / 4 * (cos_s * (2 * mid**2 - 1) - q / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    azimuth = np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
    return float(b * p * (s - fix)), float(azimuth)


def local_plane(lat0: float, lon0: float, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Azimuthal equidistant coordinates in metres around a centre."""
    polar = [geodesic(lat0, lon0, a, o) for a, o in zip(lat, lon, strict=True)]
    return np.array([(r * np.sin(z), r * np.cos(z)) for r, z in polar]).reshape(-1, 2)


def direct(lat1: float, lon1: float, distance: float, azimuth: float) -> tuple[float, float]:
    """Where a geodesic of this length and azimuth ends, by Vincenty's direct formula."""
    if distance == 0:
        return lat1, lon1
    b = _A * (1 - _FLAT)
    tan_u = (1 - _FLAT) * np.tan(np.radians(lat1))
    cos_u = 1 / np.hypot(1, tan_u)
    sin_u = tan_u * cos_u
    start = np.arctan2(tan_u, np.cos(azimuth))
    sin_a = cos_u * np.sin(azimuth)
    cos2a = 1 - sin_a**2
    k = cos2a * (_A**2 - b**2) / b**2
    p = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    q = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    s = distance / (b * p)
    for _ in range(100):
        mid = np.cos(2 * start + s)
        fix = q * np.sin(s) * (mid + q / 4 * (np.cos(s) * (2 * mid**2 - 1) - q / 6 * mid * (4 * np.sin(s) ** 2 - 3) * (4 * mid**2 - 3)))
        new = distance / (b * p) + fix
        if abs(new - s) < 1e-14:
            break
        s = new
    along = sin_u * np.sin(s) - cos_u * np.cos(s) * np.cos(azimuth)
    lat = np.arctan2(sin_u * np.cos(s) + cos_u * np.sin(s) * np.cos(azimuth), (1 - _FLAT) * np.hypot(sin_a, along))
    lam = np.arctan2(np.sin(s) * np.sin(azimuth), cos_u * np.cos(s) - sin_u * np.sin(s) * np.cos(azimuth))
    c = _FLAT / 16 * cos2a * (4 + _FLAT * (4 - 3 * cos2a))
    turn = (1 - c) * _FLAT * sin_a * (s + c * np.sin(s) * (mid + c * np.cos(s) * (2 * mid**2 - 1)))
    return float(np.degrees(lat)), float((lon1 + np.degrees(lam - turn) + 180) % 360 - 180)


def from_local_plane(lat0: float, lon0: float, xy: np.ndarray) -> np.ndarray:
    """Latitude and longitude of azimuthal equidistant coordinates."""
    return np.array([direct(lat0, lon0, float(np.hypot(x, y)), float(np.arctan2(x, y))) for x, y in xy]).reshape(-1, 2)


def _circumcircle(p):
    (ax, ay), (bx, by), (cx, cy) = p
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-9:
        return None
    x = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
    y = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
    return x, y, np.hypot(ax - x, ay - y)


def delaunay(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles whose circles hold no other point; by trial, which serves tens of points."""
    out = []
    for t in itertools.combinations(range(len(xy)), 3):
        c = _circumcircle(xy[list(t)])
        if c and not any(np.hypot(*(xy[i] - c[:2])) < c[2] - 1e-6 * max(1, c[2]) for i in range(len(xy)) if i not in t):
            out.append(t)
    return out


def predict(model: str, xy: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a model fitted on (xy, v); NaN where it has none: linear outside the hull, or a fit that fails."""
    if len(v) == 0:
        return np.full(len(at), np.nan)
    if model == "constant":
        return np.full(len(at), np.median(v))
    if model == "plane":
        if len(v) < 3:
            return np.full(len(at), np.nan)
        fit, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(v)), xy]), v, rcond=None)
        return np.column_stack([np.ones(len(at)), at]) @ fit
    if model.startswith("idw"):
        d = np.linalg.norm(at[:, None, :] - xy[None, :, :], axis=2)  # points by stations
        nodes = d <= 1e-6
        weight = np.where(nodes.any(axis=1, keepdims=True), nodes, np.maximum(d, 1e-6) ** -float(model.rpartition("p")[2]))
        return weight @ v / weight.sum(axis=1)
    if model == "linear":
        out, triangles = np.full(len(at), np.nan), delaunay(xy)
        for i, p in enumerate(at):
            for t in triangles:
                a, b, c = xy[list(t)]
                m = np.column_stack([b - a, c - a])
                if abs(np.linalg.det(m)) < 1e-9:
                    continue
                s, u = np.linalg.solve(m, p - a)
                if min(s, u, 1 - s - u) >= -1e-12:
                    out[i] = v[list(t)] @ [1 - s - u, s, u]
                    break
        return out
    raise ValueError(f"no model {model!r}; there are {', '.join(MODELS)}")


def fit_all(stations: DataFrame, nodes: DataFrame, *, lat="lat", lon="lon", value="value", models=MODELS) -> DataFrame:
    """(model, iy, ix, value, error) of each model over the nodes of a lattice (iy, ix, lat, lon).

    Models that cannot be fitted give one row with the reason in `error` and the other columns null. Control points are
    tens at most and travel with the task; nodes are dealt over all tasks."""
    got = stations.select(F.col(lat).cast("double"), F.col(lon).cast("double"), F.col(value).cast("double")).where(F.col(value).isNotNull()).orderBy(lat, lon).toPandas()
    got.columns = ["lat", "lon", "v"]
    least = {"constant": 1, "plane": 3, "linear": 3}
    center = (got["lat"].mean(), got["lon"].mean()) if len(got) else (0.0, 0.0)
    xy = local_plane(*center, got["lat"], got["lon"])
    failed = [(m, f"{m} needs {least.get(m, 1)} stations, there are {len(got)}") for m in models if len(got) < least.get(m, 1)]
    fitted = [m for m in models if m not in dict(failed)]

    def run(frames):
        for pdf in frames:
            at = local_plane(*center, pdf["lat"], pdf["lon"])
            for m in fitted:
                v = predict(m, xy, got["v"].to_numpy(), at)
                yield pd.DataFrame({"model": m, "iy": pdf["iy"], "ix": pdf["ix"], "value": np.where(np.isnan(v), None, v), "error": None})

    out = nodes.select("iy", "ix", "lat", "lon").mapInPandas(run, "model string, iy int, ix int, value double, error string")
    bad = nodes.sparkSession.createDataFrame(failed, "model string, error string")
    return out.unionByName(bad, allowMissingColumns=True)


def leave_one_out(stations: DataFrame, *, key="slug", lat="lat", lon="lon", value="value", models=MODELS) -> DataFrame:
    """(model, fold, n_train, observed, predicted, error) of each model with each station left out in turn.

    The plane is centred anew on each fold's training stations. A prediction that a model cannot make is null."""
    rows = stations.select(F.col(key).alias("fold"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(value).cast("double").alias("v")).where("v is not null")
    folds = rows.select(F.col("fold").alias("out")).distinct()
    pairs = folds.crossJoin(rows)  # stations by stations, tens of rows
    task = pairs.withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, out = key
        mine = (pdf["fold"] == out).to_numpy()
        train, test = pdf[~mine].sort_values("fold"), pdf[mine]
        n = len(train)
        if n:
            c = train["lat"].mean(), train["lon"].mean()
            got = predict(model, local_plane(*c, train["lat"], train["lon"]), train["v"].to_numpy(), local_plane(*c, test["lat"], test["lon"]))[0]
        else:
            got = np.nan
        seen = float(test["v"].iloc[0])
        got = None if np.isnan(got) else float(got)
        return pd.DataFrame({"model": [model], "fold": [out], "n_train": [n], "observed": [seen], "predicted": [got], "error": [None if got is None else got - seen]})

    return task.groupBy("model", "out").applyInPandas(fit, "model string, fold string, n_train int, observed double, predicted double, error double")


def cv_summary(folds: DataFrame) -> DataFrame:
    e = F.col("error")
    return folds.groupBy("model").agg(F.count("*").alias("n_folds"), F.count(e).alias("n_predicted"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_abs"), F.max(F.abs(e)).alias("max_abs"))


def bootstrap_median(df: DataFrame, keys: list[str], value: str, order: list[str], *, n: int = 10_000, seed: int = 20260903, alpha: float = 0.05) -> DataFrame:
    """keys, n, ci_low, ci_high of the median by resampling with PCG64; under two values no interval.

    Values are sorted by `order` first, so results do not depend on partitions. A group is one call: meant for passes."""
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "n bigint, ci_low double, ci_high double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([*order, "_v"])["_v"].to_numpy()
        out = pdf[keys].iloc[:1].copy()
        out["n"], out["ci_low"], out["ci_high"] = len(x), None, None
        if len(x) >= 2:
            rng, med = np.random.default_rng(seed), []
            for lo in range(0, n, 1000):
                med.append(np.median(x[rng.integers(0, len(x), size=(min(1000, n - lo), len(x)))], axis=1))
            out["ci_low"], out["ci_high"] = np.percentile(np.concatenate(med), [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return out

    return rows.groupBy(*keys).applyInPandas(run, schema)


def plane_by_sums(df: DataFrame, keys: list[str], x: str, y: str, v: str) -> DataFrame:
    """a + b·x + d·y by least squares from sums alone, for any number of points; null without three points that span."""
    cx, cy = F.regr_sxx(x, x), F.regr_sxx(y, y)
    xy, xv, yv = F.regr_sxy(x, y), F.regr_sxy(v, x), F.regr_sxy(v, y)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), cx.alias("sxx"), cy.alias("syy"), xy.alias("sxy"), xv.alias("sxv"), yv.alias("syv"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    ok = (F.col("n") >= 3) & (F.abs(det) > 0)
    b, d = (F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy")) / det, (F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy")) / det
    out = out.withColumns({"b": F.when(ok, b), "d": F.when(ok, d)})
    return out.select(*keys, "n", (F.col("mv") - F.col("b") * F.col("mx") - F.col("d") * F.col("my")).alias("a"), "b", "d")
