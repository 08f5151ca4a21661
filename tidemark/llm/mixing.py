"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); raking scales the cells in turn until each marginal has its target.
Targets are shares that the caller gives for a dimension, or else the token shares flattened by a power.
A document stays with a probability proportional to its cell's factor, scaled so that the expected tokens meet the
budget and cut at one. All steps on cells are window sums over the cell table, which is written every three rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import lookup
from tidemark.llm.scratch import Scratch

DIMS = ("source", "lang", "topic")
#: Target shares are the token shares to these powers, brought to a sum of one: below one they lift the small.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP, SEED, TOLERANCE, ROUNDS = 0.6, 29, 1e-6, 30
SMALL_TABLE = 100_000
GRID = 48


def topic_of(text: Column) -> Column:
    """A topic by the form of a text, for tables without one."""
    has = lambda *parts: F.coalesce(sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0)) > 0, F.lit(False))
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(has("Licensed under", "All rights reserved"), "legal")
        .when(has(" | "), "table")
        .when(has("@"), "contact")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Words, at least one, so that every text has a weight."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"))).cast("bigint")


def target_shares(cells: DataFrame, flatten: dict[str, float] = FLATTEN, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """`cells` with t_<dim>, the target tokens of each marginal.

    `targets` has for a dimension the share of each of its values (None for null); shares of values that occur are
    brought to a sum of one, and values without a share get none. Dimensions that it lacks are flattened."""
    out, total = cells, cells.agg(F.sum("tokens")).first()[0] or 0
    for d in DIMS:
        share = F.pow(F.sum("tokens"), F.lit(flatten[d]))
        if given := (targets or {}).get(d):
            table = cells.sparkSession.createDataFrame([(None if v is None else str(v), float(x)) for v, x in given.items()], "_v string, _share double")
            marginal = cells.select(F.col(d).alias("_d")).distinct().join(table, F.col("_d").cast("string").eqNullSafe(F.col("_v")), "left").select("_d", F.coalesce("_share", F.lit(0.0)).alias("share"))
        else:
            marginal = cells.groupBy(F.col(d).alias("_d")).agg(share.alias("share"))
        norm = marginal.agg(F.sum("share")).first()[0] or 1.0
        out = out.join(marginal.select("_d", (F.col("share") / norm * total).alias(f"t_{d}")), F.col(d).eqNullSafe(F.col("_d")), "left").drop("_d")
    return out


def rake(scratch: Scratch, cells: DataFrame, *, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """`cells` (tokens, t_<dim>) with `fitted`: each marginal within `tolerance` of its target, or as near as `rounds` times three sweeps bring it.

    Cells without tokens stay so; targets that no cell can meet leave a gap, as in any raking."""
    now = scratch.save(cells.withColumn("fitted", F.col("tokens").cast("double")))
    for _ in range(rounds):
        step = now
        for d in DIMS * 3:
            now_is = F.sum("fitted").over(Window.partitionBy(d))
            step = step.withColumn("fitted", F.when(now_is > 0, F.col("fitted") * F.col(f"t_{d}") / now_is).otherwise(0.0))
        after = scratch.save(step)
        scratch.drop(now)
        now = after
        gaps = [now.groupBy(d).agg(F.sum("fitted").alias("is"), F.first(f"t_{d}").alias("t")).select(F.when(F.col("t") > 0, F.abs(F.col("is") / F.col("t") - 1)).alias("gap")) for d in DIMS[:-1]]
        if (gaps[0].unionByName(gaps[1]).agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return now


def scale_for(cells: DataFrame, keep: float) -> float:
    """c with sum(tokens * min(1, c * factor)) = keep * sum(tokens), by ever finer grids."""
    f = F.col("fitted") / F.col("tokens")
    least, most, total = cells.agg(F.min(F.when(f > 0, f)), F.max(f), F.sum("tokens")).first()
    if not total or keep >= 1 or not most:
        return math.inf
    lo, hi = math.log(keep / most), math.log(1 / max(least, 1e-300))
    for _ in range(6):
        grid = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        sums = cells.agg(*(F.sum(F.least(F.lit(1.0), f * math.exp(g)) * F.col("tokens")) for g in grid)).first()
        at = next((i for i, s in enumerate(sums) if s >= keep * total), GRID - 1)
        lo, hi = grid[max(0, at - 1)], grid[at]
    return math.exp(hi)


def mix(docs: DataFrame, *, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, flatten: dict[str, float] = FLATTEN, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """Each row of `docs` as the struct `row`, with topic, n_tokens, probability and kept.

    Only doc_id, source, lang and text are read, so other columns may have any names. Null source or language is a value
    of its own. `topic` is a column of the caller's, by default a topic by the form of the text. Null and empty texts weigh
    one token. Rows of one id and text draw the same number, null ids too. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "mixing")
    cell = F.to_json(F.struct("source", "lang", "topic"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), "source", "lang", "text", (topic_of(F.col("text")) if topic is None else topic).alias("topic"))
    rows = rows.withColumn("n_tokens", tokens_of(F.col("text"))).withColumn("cell", cell)
    cells = scratch.save(rows.groupBy("cell", *DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    fitted = rake(scratch, target_shares(cells, flatten, targets))
    c = scale_for(fitted, keep)
    factor = F.lit(1.0) if math.isinf(c) else F.least(F.lit(1.0), F.col("fitted") / F.col("tokens") * c)
    odds = fitted.select("cell", factor.alias("probability"), "n")
    if odds.count() <= SMALL_TABLE:
        out = rows.join(F.broadcast(odds.drop("n")), "cell")
    else:
        out = lookup(rows, odds, ["cell"], "n")
    u = (F.pmod(F.xxhash64("_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.select("row", "topic", "n_tokens", "probability", (u < F.col("probability")).alias("kept"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept")
