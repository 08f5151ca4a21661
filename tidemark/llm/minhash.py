"""Operator 5: near-duplicate documents by min-max hashing.

Each permutation of the 5-word shingles gives its minimum and its maximum, so 56 hash evaluations make signatures of
112 values; 28 bands of two minima and two maxima, all of different permutations, find candidates. A pair at
similarity 0.75 shares no band with probability (1 - 0.75**4)**28, below 3e-5. Every link is confirmed on full sets.

Documents of equal words (by a 128-bit hash) are one node. In a first round each node meets the least node of its bands,
in groups of about BLOCK nodes. Links make components; a second round takes only band buckets that still hold more than one
component and compares, in bounded blocks, all their members across components. So of the pairs that share a band no
link is lost, and no group emits all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.graph import components, lookup
from tidemark.llm.kernels import U
from tidemark.llm.scratch import Scratch, partitions

SIZE, PERCENT = 5, 75
BANDS, PERMUTATIONS = 28, 56
BLOCK = 256
CHUNK = 1 << 20
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(U) * U(2) + U(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(U)


def shingles(raw: np.ndarray, off: np.ndarray, size: int):
    """For each row its distinct shingle hashes, sorted, and its number of words."""
    tok, _, _, first = k.word_tokens(k.LOWER[raw], off)
    p = k.prefix(tok)
    n = np.diff(first)
    whole = np.flatnonzero(k.window_starts(first, size))
    h = k.hashed(p, whole, whole + size)
    at = np.searchsorted(whole, first)
    all_of = k.hashed(p, first[:-1], first[1:])
    sets = [np.unique(h[at[i] : at[i + 1]]) if n[i] >= size else (all_of[i : i + 1] if n[i] else h[:0]) for i in range(len(n))]
    return sets, n


def word_digests(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's words, lower-cased and joined by single spaces."""
    starts, _, first = k.words_of(raw, off)
    keep, later = ~k.SPACE[raw], np.ones(len(starts), bool)
    later[first[:-1][first[:-1] < first[1:]]] = False
    keep[starts[later] - 1] = True
    left = np.concatenate([[0], np.cumsum(keep)])
    inside = k.LOWER[raw[keep]]
    inside[k.SPACE[inside]] = 32
    both = k.digests(inside, left[off])
    return both[:, 0], both[:, 1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, BANDS for each non-empty set."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low, high = np.empty((PERMUTATIONS, len(sets)), U), np.empty((PERMUTATIONS, len(sets)), U)
    for i in range(PERMUTATIONS):
        v = (x ^ _B[i]) * _A[i]
        v ^= v >> U(32)
        low[i], high[i] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
    out = np.empty((len(sets), BANDS), U)
    for b in range(BANDS):
        i, j = 2 * b, (2 * b + 2) % PERMUTATIONS
        key = k.mix(low[i] + U(b + 1))
        for part in (low[i + 1], high[j], high[j + 1]):
            key = k.mix(key ^ part) * U(k.BASE)
        out[:, b] = key
    return out


def _sign(size: int):
    def run(batches):
        for batch in batches:
            raw, off = k.texts_of(batch.column(1))
            for lo, hi in k.chunks(off, CHUNK):
                part = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                sets, (k1, k2) = shingles(*part, size)[0], word_digests(*part)
                some = np.array([len(s) > 0 for s in sets], bool)
                bands = signatures([s for s in sets if len(s)]) if some.any() else np.zeros((0, BANDS), U)
                ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def linked(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join all that can be joined."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        if comp[0] == comp[1]:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    comp, out = comp.copy(), []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(comp[rest] != comp[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if not len(rest):
            continue
        mark = np.zeros(len(values), bool)
        mark[code[at[i] : at[i + 1]]] = True
        if 4 * len(rest) >= len(sets):
            both = np.add.reduceat(mark[code].astype(np.int64), at[:-1])[rest]
        else:
            both = np.array([np.count_nonzero(mark[code[at[j] : at[j + 1]]]) for j in rest], np.int64)
        for j in rest[100 * both >= percent * (size[i] + size[rest] - both)]:
            if comp[j] != comp[i]:
                out.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]
    return out


def _verify(size: int, percent: int):
    """Batches come sorted by group; groups are small, so one is held at a time."""

    def close(held):
        ids = np.concatenate([np.asarray(h[0]) for h in held])
        comp = np.concatenate([np.asarray(h[1]) for h in held])
        sets: list[np.ndarray] = []
        for _, _, texts in held:
            raw, off = k.texts_of(texts)
            for lo, hi in k.chunks(off, CHUNK):
                sets += shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)[0]
        return [(int(ids[i]), int(ids[j])) for i, j in linked(sets, comp, percent) if ids[i] != ids[j]]

    def run(batches):
        group, held, out = None, [], []
        for batch in batches:
            g = np.asarray(batch.column(0))
            cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]) if len(g) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if g[a] != group and held:
                    out += close(held)
                    held = []
                group = g[a]
                held.append((batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)))
        if held:
            out += close(held)
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return run


def _confirm(scratch: Scratch, texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within groups; `members` has g, doc_id and comp."""
    n = partitions(texts.sparkSession)
    rows = members.hint("merge").join(texts, "doc_id").select("g", "doc_id", "comp", "text")  # one plan at every size
    return scratch.save(rows.repartition(n, "g").sortWithinPartitions("g", "doc_id").mapInArrow(_verify(size, percent), "u bigint, v bigint"))


def _second_round(scratch: Scratch, buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, in blocks that pair each small part with the rest."""
    at = scratch.save(buckets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("b", "doc_id", F.coalesce("component", "doc_id").alias("comp")))
    per = at.groupBy("b", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"))
    mixed = per.groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("most")).where("n > most")
    one = scratch.save(mixed.groupBy("n", "s", "major", "most").agg(F.min("b").alias("b")).drop("s"))
    rows = lookup(at, one.withColumn("held", F.col("n")), ["b"], "held")
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    few, many = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    i = deal(few)
    of_major = F.transform(upto(few), lambda x: F.struct(x.alias("i"), deal(many).alias("j"), F.lit(0).alias("kind")))
    of_minor = F.concat(
        F.transform(upto(many), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(0).alias("kind"))),
        F.transform(upto(few), lambda x: F.struct(F.least(x, i).alias("i"), F.greatest(x, i).alias("j"), F.lit(1).alias("kind"))),
    )
    out = rows.withColumn("block", F.explode(F.when(F.col("comp") == F.col("major"), of_major).otherwise(of_minor)))
    return out.select(F.xxhash64("b", "block.i", "block.j", "block.kind").alias("g"), "doc_id", "comp").distinct()


def near_duplicates(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Null ids link with nothing
    and are kept. Rows of one id count as one document for links. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.save(texts.mapInArrow(_sign(size), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    live = signed.where("n_shingles > 0 and doc_id is not null")
    same = scratch.save(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    chiefs = live.join(same.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"]).select("doc_id", F.explode(F.array_distinct("bands")).alias("b"))
    least = scratch.save(chiefs.groupBy("b").agg(F.min("doc_id").alias("m"), F.count("*").alias("n")).where("n > 1"))
    buckets = scratch.save(lookup(chiefs, least, ["b"], "n"))

    pairs = scratch.save(buckets.groupBy("doc_id").agg(F.min("m").alias("m")).where("m < doc_id"))
    sizes = scratch.save(pairs.groupBy("m").agg(F.count("*").alias("size")))
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK))
    pairs = lookup(pairs, sizes.withColumn("held", F.col("size")), ["m"], "held").withColumn("g", F.xxhash64("m", salt))
    members = pairs.select("g", "doc_id").unionByName(pairs.select("g", F.col("m").alias("doc_id")).distinct()).withColumn("comp", F.col("doc_id"))
    edges = _confirm(scratch, texts, members, size, percent)
    comps = components(scratch, edges)
    more = _confirm(scratch, texts, scratch.save(_second_round(scratch, buckets, comps)), size, percent)
    if not more.isEmpty():
        comps = components(scratch, edges.unionByName(more))
    named = scratch.save(same.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id")))
    out = lookup(live.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"], "n").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
