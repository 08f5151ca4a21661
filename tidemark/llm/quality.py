"""Operator 10: quality by importance resampling.

Hashed unigrams and bigrams give two bag models: of the target (labelled good and not toxic, a bounded sample) and of
raw text (all documents). For each order a document's evidence is the sum over its n-grams of log(target / raw); ratios
within a factor of two say nothing at these counts and count as one, and PRIOR keeps rare n-grams near one. Such sums
grow with length even in clean text and count dependent n-grams as if they were not, so they are divided by a power of
the length and calibrated on the labelled sample to what they stand for, a log ratio of good to bad. To these log
weights comes Gumbel noise of scale one, and the top k documents stay: a sample without replacement in proportion to the
weights. k is a parameter; by default it is the number of documents that are good more likely than not. The k-th key is
found by counting in ever finer bins, never by a full sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.kernels import U
from tidemark.llm.scratch import Scratch

BUCKETS, RANGES = 1 << 20, 32
LABELLED, PRIOR, DEAD, TEMPERATURE, SEED = 20_000, 8.0, 0.7, 1.0, 17
#: Of unigrams and bigrams: by which power of the length the evidence is divided, and its share in the weight.
POWERS, SHARES = (0.75, 0.5), (1.0, 0.5)
CHUNK = 2 << 20
BINS = 1000


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each unigram and each bigram of lower-cased words; bigrams have buckets of their own."""
    tok, _, _, first = k.word_tokens(k.LOWER[raw], off)
    row = k.spans(first, len(tok))
    pair = k.window_starts(first, 2)
    two = k.mix(tok[:-1] * U(3) + (tok[1:] ^ U(0x9E3779B97F4A7C15))) if len(tok) > 1 else tok[:0]
    two = two[pair[:-1]] if len(tok) > 1 else two
    shift = U(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([(tok >> shift).astype(np.int64), (two >> shift).astype(np.int64) + BUCKETS]), np.concatenate([row, row[pair]])


def _count(batches):
    raw_n, good_n = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        raw, off = k.texts_of(batch.column(0))
        good = np.asarray(batch.column(1))
        for lo, hi in k.chunks(off, CHUNK):
            bucket, row = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            raw_n += np.bincount(bucket, minlength=2 * BUCKETS)
            if good[lo:hi].any():
                good_n += np.bincount(bucket[good[lo:hi][row]], minlength=2 * BUCKETS)
    keys, size = k.route_keys(RANGES), 2 * BUCKETS // RANGES
    for r in range(RANGES):
        at = np.flatnonzero(raw_n[r * size : (r + 1) * size])
        blob = k.dump(at=at.astype(np.int32), raw=raw_n[at + r * size], good=good_n[at + r * size])
        yield pa.record_batch([pa.array([keys[r]], pa.int32()), pa.array([r], pa.int32()), pa.array([blob], pa.binary())], names=["part", "range", "blob"])


def _sum(batches):
    size, sums = 2 * BUCKETS // RANGES, {}
    for batch in batches:
        for r, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = k.load(blob.as_py())
            raw, good = sums.setdefault(r, (np.zeros(size, np.int64), np.zeros(size, np.int64)))
            raw[x["at"]] += x["raw"]
            good[x["at"]] += x["good"]
    for r, (raw, good) in sums.items():
        yield pa.record_batch([pa.array([r], pa.int32()), pa.array([k.dump(raw=raw, good=good)], pa.binary())], names=["range", "blob"])


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of target over raw for each bucket, unigrams and bigrams each scaled to their totals."""
    out = np.zeros(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        if raw[half].sum() and good[half].sum():
            expected = raw[half] * (good[half].sum() / raw[half].sum())
            r = np.log((good[half] + PRIOR) / (expected + PRIOR))
            out[half] = np.where(np.abs(r) > DEAD, r, 0.0)
    return out


def _ratios(counts: DataFrame) -> np.ndarray:
    """The log ratios of all buckets from the tasks' counts; RANGES rows of fixed size reach the driver."""
    raw, good, size = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64), 2 * BUCKETS // RANGES
    for r in counts.repartition(RANGES, "part").mapInArrow(_sum, "range int, blob binary").collect():
        x = k.load(bytes(r["blob"]))
        raw[r["range"] * size :][:size], good[r["range"] * size :][:size] = x["raw"], x["good"]
    return log_ratio(raw, good).astype(np.float32)


def _score(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            raw, off = k.texts_of(batch.column(2))
            parts = [np.zeros((3, 0))]
            for lo, hi in k.chunks(off, CHUNK):
                bucket, row = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                two = bucket >= BUCKETS
                r = ratio[bucket]
                parts.append(np.stack([np.bincount(row[~two], r[~two], hi - lo), np.bincount(row[two], r[two], hi - lo), np.bincount(row[~two], minlength=hi - lo)]))
            one, both, n = np.concatenate(parts, 1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(one), pa.array(both), pa.array(n)], names=["doc_id", "row_key", "e1", "e2", "n"])

    return run


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight at or above which a document counts as good, with the fewest errors on the sample."""
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    free = np.concatenate([[True], w[1:] > w[:-1], [True]])
    at = int(np.argmin(np.where(free, wrong, len(w) + 1)))
    if at == 0:
        return -np.inf
    return np.inf if at == len(w) else (w[at - 1] + w[at]) / 2


def calibrated(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(a, b) of the log odds a * x + b of good, fitted by Newton steps to shares that are never quite 0 or 1."""
    hi, lo = (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2)
    want = np.where(good, hi, lo)
    spread = float(np.std(x)) or 1.0
    z = (x - float(np.median(x))) / spread
    design, beta = np.stack([z, np.ones(len(z))], 1), np.zeros(2)
    loss = lambda t: float(np.logaddexp(0, design @ t).sum() - want @ (design @ t))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (want - p))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * np.median(x) / spread)


def top_threshold(keys: DataFrame, wanted: int) -> tuple[float, int]:
    """(t, m): the `wanted` rows of largest `key` are those above t and m of those at t."""
    lo, hi, above = *(keys.agg(F.min("key"), F.max("key")).first()), 0
    while lo < hi:
        width = (hi - lo) / BINS
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        rows = keys.where(F.col("key").between(lo, hi)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= wanted:
                if (r["lo"], r["hi"]) == (lo, hi) and len(rows) == 1:
                    return r["lo"], wanted - above
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo, wanted - above


def row_key() -> Column:
    """What rows of one id and text share."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, labelled: int = LABELLED, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, weight (a log ratio), key and kept of each row of `docs`; `labels` has doc_id, quality and toxic.

    At most `labelled` labelled rows, those of least hash of their ids, fit the target and the calibration; raw counts
    cover all documents. `k` rows stay, by default as many as have a weight above zero. Null and empty texts have evidence 0.
    Unless there are good and bad labels nothing is calibrated, and without `k` all documents stay. Rows of one id and
    text draw one noise, so repeated rows tie; ties at the k-th key all stay. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    sample = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.min("quality") > 0).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic"))
    sample = scratch.save(sample.select("doc_id", (F.col("fine") & ~F.col("toxic")).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), "text")
    known = texts.join(F.broadcast(sample), "doc_id", "left")  # the sample has at most `labelled` rows
    counts = known.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count, "part int, range int, blob binary")
    evidence = scratch.save(texts.mapInArrow(_score(_ratios(counts)), "doc_id bigint, row_key bigint, e1 double, e2 double, n double"))
    seen = evidence.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).toArrow()  # at most `labelled` rows
    scales, slope, shift = [1.0, 1.0], 1.0, np.inf
    fine = seen["good"].to_numpy() if seen.num_rows else np.zeros(0, bool)
    if fine.any() and not fine.all():
        parts = [seen[f"e{i + 1}"].to_numpy() / (seen["n"].to_numpy() + 20) ** p for i, p in enumerate(POWERS)]
        scales = [abs(c) if np.isfinite(c := best_cut(x, fine)) and c else 1.0 for x in parts]
        slope, shift = calibrated(sum(h * x / c for h, x, c in zip(SHARES, parts, scales, strict=True)), fine)
    terms = [F.col(f"e{i + 1}") / F.pow(F.col("n") + 20, F.lit(p)) * (slope * h / c) for i, (p, h, c) in enumerate(zip(POWERS, SHARES, scales, strict=True))]
    weight = terms[0] + terms[1] + (shift if np.isfinite(shift) else 0.0)
    u = (F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = evidence.select("doc_id", "row_key", weight.alias("weight")).withColumn("key", F.col("weight") - temperature * F.log(-F.log(u)))
    wanted = k if k is not None else scored.where(F.col("weight") > 0).count() if np.isfinite(shift) else None
    if wanted is None or wanted <= 0:
        return scored.withColumn("kept", F.lit(wanted is None))
    least, _ = top_threshold(scored.select("key"), wanted)
    return scored.withColumn("kept", F.col("key") >= least)


def op10_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "weight", "kept")
