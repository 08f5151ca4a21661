"""Operator 1: near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted, and cut into cells of WIDTH; DEPTH cells make the key of
one of TABLES tables. A pair at cosine 0.98 (distance 0.2) shares a cell with probability 0.92, a key with 0.37, and
misses all tables with probability below 2e-5. Cosines are then taken exactly, in double precision.

Equal vectors are one node with a count. A bucket of any size is dealt into blocks of at most about BLOCK nodes, and
each pair of blocks is compared by matrix products of TILE rows; a pair counts only in the first table whose key it
shares, so link counts need no shuffle of pairs. A node of a bucket travels once for each BLOCK others.
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

THRESHOLD = 0.98
TABLES, DEPTH, WIDTH, BLOCK, TILE = 24, 12, 2.0, 4096, 256


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections of a vector of `dim` components; the first components' rows are the same for every dim."""
    rng = np.random.default_rng(11)
    shift = rng.uniform(0, WIDTH, TABLES * DEPTH)
    return rng.standard_normal((dim, TABLES * DEPTH)), shift


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A key of each table for each unit vector, of vectors of one length."""
    a, shift = _directions(x.shape[1])
    cell = np.floor((x @ a + shift) / WIDTH).astype(np.int64).astype(U).reshape(len(x), TABLES, DEPTH)
    out = np.broadcast_to(k.mix(label.astype(U) * U(k.BASE) + U(x.shape[1]))[:, None], (len(x), TABLES)) + np.arange(TABLES, dtype=U) * U(0x9E3779B1)
    for d in range(DEPTH):
        out = k.mix(out ^ cell[:, :, d]) * U(k.BASE) + U(d)
    return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64), np.diff(np.asarray(column.offsets))


def _hash(batches):
    for batch in batches:
        n = batch.num_rows
        flat, size = _lists(batch.column(2))
        at, label = np.concatenate([[0], np.cumsum(size)]), np.asarray(batch.column(1)).astype(np.int64)
        keys = np.zeros((n, TABLES), U)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            for part in np.array_split(rows, max(1, len(rows) // 1000)):
                keys[part] = keys_of(unit(flat[at[part][:, None] + np.arange(dim)]), label[part])
        yield pa.record_batch([batch.column(0), batch.column(3), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel().view(np.int64)))], names=["rep", "n", "embedding", "keys"])


def block_links(x: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, across: bool, threshold: float):
    """Pairs (i, j), i < j, at `threshold` or more that share no key of an earlier table, for each tile of rows i."""
    for lo in range(0, len(x), TILE):
        cos = x[lo : lo + TILE] @ x[lo:].T
        near = np.triu(cos >= threshold - 1e-9, 1)
        if across:
            near &= side[lo : lo + TILE, None] != side[None, lo:]
        i, j = np.nonzero(near)
        sure = cos[i, j] >= threshold + 1e-9
        i, j = i + lo, j + lo
        unsure = np.flatnonzero(~sure)
        sure[unsure] = (x[i[unsure]] * x[j[unsure]]).sum(axis=1) >= threshold
        i, j = i[sure], j[sure]
        if table and len(i):
            new = np.ones(len(i), bool)
            for at in range(0, len(i), 100_000):
                s = slice(at, at + 100_000)
                new[s] = ~(keys[i[s], :table] == keys[j[s], :table]).any(axis=1)
            i, j = i[new], j[new]
        yield i, j


def _compare(threshold: float):
    """Batches come sorted by group. Gives rows (u, v, null) for links that join components and (u, null, links)."""

    def close(held):
        flat, size = zip(*(_lists(h.column("embedding")) for h in held), strict=True)
        get = lambda c: np.concatenate([np.asarray(h.column(c)) for h in held])
        keys = np.concatenate([np.asarray(h.column("keys").combine_chunks().flatten() if isinstance(h.column("keys"), pa.ChunkedArray) else h.column("keys").flatten()) for h in held]).reshape(-1, TABLES)
        rep, n, side = get("rep"), get("n"), get("side")
        size = np.concatenate(size)
        if len(rep) < 2 or (size != size[0]).any():
            return []
        links, comp, out = np.zeros(len(rep)), np.arange(len(rep)), []
        for i, j in block_links(unit(np.concatenate(flat).reshape(len(rep), -1)), keys, int(get("t")[0]), side, bool(get("across")[0]), threshold):
            links += np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
            if not len(i):
                continue
            rows, cut = np.unique(i, return_index=True)
            for a, js in zip(rows, np.split(j, cut[1:]), strict=True):
                labels, one = np.unique(comp[js], return_index=True)
                for label, b in zip(labels, js[one], strict=True):
                    if label != comp[a]:
                        out.append((int(rep[a]), int(rep[b]), None))
                        comp[comp == label] = comp[a]
        out += [(int(rep[a]), None, int(links[a])) for a in np.flatnonzero(links)]
        return out

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
                held.append(batch.slice(a, b - a))
            if len(out) > 50_000:
                yield _links(out)
                out = []
        if held:
            out += close(held)
        yield _links(out)

    return run


def _links(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["u", "v", "links"])


def similar_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Only vectors of equal, non-null labels and equal lengths are compared. Vectors that are null, empty or zero or hold
    null or non-finite components, and rows without id, link with nothing. Each repeated row counts, and rows of one id
    with different vectors are linked each by its own. An empty table gives an empty result. Other columns are not read."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pstable")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    live = rows.where("good").withColumns({"e1": F.xxhash64("label", "embedding"), "e2": F.xxhash64("embedding", "label", F.lit(7))})
    same = scratch.save(live.groupBy("e1", "e2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    chiefs = live.join(same.select("e1", "e2", F.col("least").alias("vec_id"), "n", "rep"), ["e1", "e2", "vec_id"]).dropDuplicates(["rep"])
    nodes = scratch.save(chiefs.select("rep", "label", "embedding", "n").mapInArrow(_hash, "rep bigint, n bigint, embedding array<double>, keys array<bigint>"))
    cells = nodes.select("rep", F.posexplode("keys").alias("t", "b"))
    full = scratch.save(cells.groupBy("b").agg(F.count("*").alias("size")).where("size > 1"))
    at = lookup(cells, full.withColumn("held", F.col("size")), ["b"], "held")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    i = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, i).alias("i"), F.greatest(x, i).alias("j")))
    groups = at.withColumn("p", F.explode(pairs)).select(F.xxhash64("b", "p.i", "p.j").alias("g"), "rep", "t", i.alias("side"), (F.col("p.i") != F.col("p.j")).alias("across"))
    held = groups.join(nodes, "rep").select("g", "rep", "t", "side", "across", "n", "embedding", "keys")
    found = scratch.save(held.repartition(partitions(spark), "g").sortWithinPartitions("g", "rep").mapInArrow(_compare(threshold), "u bigint, v bigint, links bigint"))
    comps = components(scratch, found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    least = scratch.save(comps.join(same.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    links = found.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    named = same.join(lookup(comps, least, ["component"], "size").drop("component"), "rep", "left").join(links, "rep", "left")
    named = scratch.save(named.select("e1", "e2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = lookup(live.select("vec_id", "e1", "e2"), named, ["e1", "e2"], "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
