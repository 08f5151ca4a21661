"""Joins that survive hot keys, and connected components without a driver-side step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: A key counts as hot beyond this share of the rows, so there are at most 1 / HOT_SHARE hot keys, few enough to send to all.
HOT_SHARE = 1 / 1000
SALTS = 8


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner equi-join; `right` has one row for each key and in `count` how many rows of `left` have it.

    Rows of hot keys stay where they are and get their partner by broadcast, which HOT_SHARE bounds."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) > max(1000, total * HOT_SHARE))
    if hot.isEmpty():
        return left.join(right.drop(count), keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) <= max(1000, total * HOT_SHARE)).drop(count), keys)
    return left.join(F.broadcast(hot.drop(count)), keys).select(*cold.columns).unionByName(cold)


def _salted_min(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with m, the least of u and of all v beside it; a hub's pairs meet in SALTS places."""
    low = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"]).select("u", "v", "m")


def _starred(edges: DataFrame) -> bool:
    """Whether each component is a star around its least node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    at = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return at.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge the least node it can reach. `edges` has columns u and v.

    Alternating large-star and small-star steps; each result is written to the shared folder, so a lost executor costs
    one step at most. The steps grow with the logarithm of a component's size."""
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = scratch.save(ordered(edges))
    while not _starred(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _salted_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _salted_min(large)
        turned = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = scratch.save(turned.distinct())
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
