"""Search of granules by place and time: rows with a box and an interval that meet those of areas and periods.

Both sides are dealt into cells of a pyramid of space and time. A row lies on the level whose cells are as large as it is,
so it touches eight of them at most, whether it covers a bay or the earth, an hour or a decade; and rows meet on the coarser
of their two levels, in the cell that holds the south-western and earliest corner of what they share, so each pair comes
once. It is an equi-join by cell; no pair of rows is compared that shares no cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, finite

#: Cells of level 0: degrees and days. Each level is twice as large; the last one holds all the earth and 44 years.
DEGREES, DAYS, LEVELS = 0.5, 0.25, 16
BOX = ("west", "south", "east", "north")


def _seconds(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp")) / 1e6


def _level(extent: Column, cell: float) -> Column:
    """The least level whose cells are at least as long as the extent."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell)))).cast("int")


def _prepared(df: DataFrame, start: str, end: str) -> DataFrame:
    """The rows with finite boxes and whole intervals, and their level."""
    box = [finite(c) for c in BOX]
    w, s, e, n = box
    a, b = _seconds(start), _seconds(end)
    rows = df.select(F.struct("*").alias("row"), *(c.alias(x) for c, x in zip([w, s, e, n, a, b], "wsenab", strict=True)))
    rows = rows.where("w is not null and s is not null and e is not null and n is not null and a is not null and b is not null and s <= n and a <= b")
    # a box over the meridian of 180 degrees is two
    rows = rows.withColumn("sides", F.when(F.col("w") <= F.col("e"), F.array(F.struct("w", "e"))).otherwise(F.array(F.struct("w", F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), "e"))))
    rows = rows.select("*", F.posexplode("sides").alias("part", "side")).withColumns({"w": F.col("side.w"), "e": F.col("side.e")}).drop("side")
    return rows.withColumn("own", F.greatest(_level(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")), DEGREES), _level(F.col("b") - F.col("a"), DAYS * 86400)))


def _cells(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Each row once for each cell that it touches on its own level and on the coarser ones that the other side has."""
    at = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
    rows = rows.withColumn("level", F.explode(F.array_union(F.array("own"), F.filter(at, lambda x: x > F.col("own")))))
    size, span = DEGREES * F.pow(F.lit(2.0), F.col("level")), DAYS * 86400 * F.pow(F.lit(2.0), F.col("level"))
    for name, lo, hi, unit in (("x", "w", "e", size), ("y", "s", "n", size), ("t", "a", "b", span)):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / unit), F.floor(F.col(hi) / unit))))
    return rows


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r["own"] for r in rows.select("own").distinct().collect())  # LEVELS + 1 at most


def search(granules: DataFrame, areas: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs (granule, area), each a struct of its row, whose boxes and intervals meet; edges and ends count, and each pair comes once.

    Both sides have west, south, east, north in degrees (west > east: over the meridian of 180 degrees) and an interval. Rows
    with a null or non-finite bound, or an interval that ends before it starts, meet nothing."""
    g, q = _prepared(granules, start, end), _prepared(areas, start, end)
    left, right = _cells(g, _levels(q)), _cells(q, _levels(g))
    l, r = left.select(*(F.col(c).alias(f"l_{c}" if c not in ("level", "x", "y", "t") else c) for c in left.columns)), right.select(*(F.col(c).alias(f"r_{c}" if c not in ("level", "x", "y", "t") else c) for c in right.columns))
    both = l.join(r, ["level", "x", "y", "t"]).where(F.col("level") == F.greatest("l_own", "r_own"))
    meets = [F.col(f"l_{lo}") <= F.col(f"r_{hi}") for lo, hi in (("w", "e"), ("s", "n"), ("a", "b"))] + [F.col(f"r_{lo}") <= F.col(f"l_{hi}") for lo, hi in (("w", "e"), ("s", "n"), ("a", "b"))]
    size, span = DEGREES * F.pow(F.lit(2.0), F.col("level")), DAYS * 86400 * F.pow(F.lit(2.0), F.col("level"))
    first = [F.col(c) == F.floor(F.greatest(f"l_{lo}", f"r_{lo}") / unit) for c, lo, unit in (("x", "w", size), ("y", "s", size), ("t", "a", span))]
    # halves of boxes may meet in several ways; the first of them counts
    ways = F.flatten(F.transform("l_sides", lambda p, i: F.transform("r_sides", lambda q, j: F.when((p["w"] <= q["e"]) & (q["w"] <= p["e"]), F.struct(i.alias("i"), j.alias("j"))))))
    once = F.array_min(ways) == F.struct(F.col("l_part").alias("i"), F.col("r_part").alias("j"))
    return both.where(reduce(lambda a, b: a & b, [*meets, *first, once])).select(F.col("l_row").alias("granule"), F.col("r_row").alias("area"))
