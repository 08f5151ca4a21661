"""Operator 4: benchmark decontamination by template windows, in DataFrame functions only.

Numbers, units and mid-sentence names become typed placeholders, so a question with other values keeps its template.
Windows of WINDOW template tokens are hashed and joined to the benchmark's. A document is a candidate for an item that it
covers well enough; there the values behind equal slots are compared, for each occurrence of the item and over all of them: each value of the item must stand for one value of
the document throughout, as it does in a re-parameterised copy and does not in text that only shares a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, COVERAGE, ENOUGH, CONSISTENT = 8, 0.5, 24, 0.8
#: Windows with fewer literal tokens say too little.
LITERALS = 4
#: Windows of a benchmark that take at most so many bytes are sent to all executors; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
NUM, NAME, UNIT, JOINT = "", "", "", ""
# Units that follow a number.
UNITS = "mm|cm|km|m|mg|kg|g|t|ml|cl|l|s|min|h|hz|khz|mhz|ghz|w|kw|mw|v|a|pa|kpa|bar|j|kj|cal|kcal|mph|kmh|miles|mile|feet|foot|ft|inches|inch|yards|yard|pounds|pound|lb|oz|gallons|gallon|litres|liters|metres|meters|seconds|minutes|hours|days|weeks|months|years|percent|dollars|cents|euros|degrees"


def template(text: Column, values: bool) -> Column:
    """Template tokens of a text; with `values` the slots keep what they stand for behind their marks."""
    more = "$0" if values else ""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[-]", " ")
    t = F.lower(F.regexp_replace(t, r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+", NAME + more))
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", JOINT)
    t = F.regexp_replace(t, rf"(?<=\d) ?({UNITS})(?![a-z0-9ª-퟿])", f" {UNIT}" + ("$1" if values else ""))
    t = F.regexp_replace(t, r"\d[\d]*", f" {NUM}{more} ")
    return F.array_remove(F.split(t, r"[^a-z0-9ª-￿]+"), "")


def _hashes(tokens: Column) -> Column:
    """Hash of each window. The tokens pass through a lambda, so that they are computed once and not for each window."""
    windows = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - WINDOW), lambda i: F.xxhash64(F.slice(t, i + 1, WINDOW)))
    none = F.array().cast("array<bigint>")
    return F.flatten(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= WINDOW, windows(t)).otherwise(none)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """h, item_id, total (windows of the item that count) and slots, the window's tokens with values."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), template(F.col("text"), False).alias("tok"), template(F.col("text"), True).alias("val"))
    rows = items.select("item_id", "tok", "val", F.posexplode(_hashes(F.col("tok"))).alias("at", "h"))
    part = lambda c: F.slice(c, F.col("at") + 1, WINDOW)
    literal = F.size(F.filter(part("tok"), lambda x: ~x.isin(NUM, NAME, UNIT)))
    rows = rows.where(literal >= LITERALS).select("item_id", "at", "h", part("val").alias("slots"))
    total = rows.groupBy("item_id").agg(F.countDistinct("h").alias("total"))
    return rows.join(total, "item_id")


def _places(shift: Column, total: Column) -> Column:
    """Where a hit may belong to: the whole document, and occurrences of the item by the shift of its position.

    An occurrence is a shift exactly, or a band of shifts where words are put in or left out: of 8 tokens, or of half the
    item, each on two grids, so a spread of half a band stays together and copies that follow each other stay apart."""
    wide = F.greatest(F.lit(2), F.floor((total + WINDOW) / 2)).cast("bigint")
    band = lambda kind, bin: F.struct(F.lit(kind).alias("kind"), F.floor(bin).cast("bigint").alias("bin"))
    bands = [band(2, shift / 8), band(3, (shift + 4) / 8), band(4, shift / wide), band(5, shift / wide + 0.5)]
    return F.array(band(0, F.lit(0)), band(1, shift), *bands)


def _join(rows: DataFrame, windows: DataFrame, on: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(windows) if small else windows.hint("shuffle_hash"), on)


def _plain(text: Column) -> Column:
    """Tokens of a text with their values and without the marks of slots."""
    return F.transform(template(text, True), lambda x: F.translate(x, NUM + NAME + UNIT, ""))


def whole_items(texts: DataFrame, benchmark: DataFrame, windows: DataFrame) -> DataFrame | None:
    """The held items that have no window of `windows`, found by all their tokens with the exact values; None without such items."""
    slot = lambda x: F.substring(x, 1, 1).isin(NUM, NAME, UNIT)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").join(windows.select("item_id").distinct(), "item_id", "left_anti")
    items = items.select("item_id", _plain(F.col("text")).alias("tok"), F.size(F.filter(template(F.col("text"), True), slot)).cast("bigint").alias("n_slots"))
    items = items.where(F.size("tok") > 0).select("item_id", F.size("tok").alias("n"), F.xxhash64("tok").alias("h"), "n_slots")
    lengths = sorted(x["n"] for x in items.select("n").distinct().collect())
    if not lengths:
        return None
    of = lambda t, n: F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(F.slice(t, i + 1, n)))
    runs = lambda t: F.flatten(F.transform(F.filter(F.lit(lengths), lambda n: n <= F.size(t)), lambda n: of(t, n)))
    hits = texts.select("_key", "doc_id", F.explode(F.array_distinct(F.flatten(F.transform(F.array(_plain(F.col("text"))), runs)))).alias("h"))
    held = _join(hits, items, ["h"], items.count() * 64 <= BROADCAST_BYTES).dropDuplicates(["_key", "item_id"])
    return held.select("doc_id", "item_id", F.lit(1).cast("bigint").alias("n_windows"), F.lit(1.0).alias("coverage"), "n_slots", F.lit(1.0).alias("consistency"), "_key")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots and consistency of each document that holds an item, and `_key`.

    An item counts as held if COVERAGE of its windows, or ENOUGH of them, occur in the document, with consistent slots,
    in one occurrence (_places) or over all; the figures are of the one of most windows.
    Null and empty texts hold nothing; an item without a window that counts is held
    where all its tokens stand in a row with the same values, as one window; equal items are each reported; rows
    of one id and text are reported once, null ids too. Empty tables give an empty result. Other columns are not read."""
    windows = benchmark_windows(benchmark)
    bytes_of = F.octet_length(F.array_join("slots", " ")) + 32 * WINDOW  # strings in a hash table take some more than their letters
    small = (windows.agg(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    hits = texts.select("_key", "doc_id", F.explode(_hashes(template(F.col("text"), False))).alias("h"))
    found = _join(hits, windows.select("h", "item_id", "total").distinct(), ["h"], small).groupBy("_key", "doc_id", "item_id", "total").agg(F.countDistinct("h").alias("n_windows"))
    share = F.col("n_windows") / F.col("total")
    found = found.where((share >= COVERAGE) | (F.col("n_windows") >= ENOUGH)).select("_key", "item_id", "n_windows", share.alias("coverage"))

    held = texts.dropDuplicates(["_key"]).join(found.select("_key").distinct(), "_key", "left_semi")
    spots = held.withColumns({"tok": template(F.col("text"), False), "val": template(F.col("text"), True)}).select("_key", "val", F.posexplode(_hashes(F.col("tok"))).alias("at", "h"))
    both = _join(spots.select("_key", "h", F.col("at").alias("spot"), F.slice("val", F.col("at") + 1, WINDOW).alias("mine")), windows.select("h", "item_id", "at", "total", "slots"), ["h"], small)
    slot = lambda x: F.substring(x, 1, 1).isin(NUM, NAME, UNIT)
    both = both.select("_key", "item_id", "h", "total", "slots", "mine", F.explode(_places(F.col("spot") - F.col("at"), F.col("total"))).alias("place"))
    by = ["_key", "item_id", "place"]
    cover = both.groupBy(*by, "total").agg(F.countDistinct("h").alias("n_windows")).withColumn("coverage", F.col("n_windows") / F.col("total"))
    cover = cover.where((F.col("coverage") >= COVERAGE) | (F.col("n_windows") >= ENOUGH)).drop("total")
    pairs = both.select(*by, F.explode(F.filter(F.arrays_zip("slots", "mine"), lambda x: slot(x["slots"]))).alias("p"))
    counts = pairs.groupBy(*by, F.col("p.slots").alias("theirs"), F.col("p.mine").alias("ours")).agg(F.count("*").alias("n"))
    per = counts.groupBy(*by, "theirs").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    slots = per.groupBy(*by).agg(F.sum("n").alias("n_slots"), (F.sum("top") / F.sum("n")).alias("consistency"))
    out = cover.join(slots, by, "left").withColumn("good", F.coalesce("consistency", F.lit(1.0))).where(F.col("good") >= CONSISTENT)
    rank = F.struct("n_windows", "good", F.col("place.kind"), F.col("place.bin"))
    out = out.groupBy("_key", "item_id").agg(F.max_by(F.struct("n_windows", "coverage", "n_slots", "consistency"), rank).alias("x")).select("_key", "item_id", "x.*")
    out = out.join(held.select("_key", "doc_id"), "_key")
    whole = whole_items(texts, benchmark, windows)
    out = out.select("doc_id", "item_id", "n_windows", "coverage", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"), "_key")
    return out if whole is None else out.unionByName(whole)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item; all columns stay."""
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("_key"))
    return marked.join(contaminated(docs, benchmark).select("_key").distinct(), "_key", "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "n_windows", F.round("coverage", 6).alias("coverage"), "n_slots", F.round("consistency", 6).alias("consistency"))
