"""Operator 7: near-equal lines across documents, in DataFrame functions only.

Lines are normalised (lower-case words); those of MIN_WORDS words or more are compared, shorter ones (with `short`) only
meet their equals: by their words or, without any, by the text itself between its blanks. A SimHash has 64 bits: the
words of a line are exploded where the line lies, and sums of packed counters give all bits. Longer words weigh more,
else the few most common words, which all lines share, would set most bits.

Candidates share a key. Of four blocks of 16 bits each two make a key, so two lines within Hamming distance 2 share one, and keys that unrelated
lines share stay few in large tables. A quarter
of the words changed moves about 15 bits, more than any useful block allows, so each line also has SKETCH keys that are
the least of its runs of three words by one hash each, runs without a long word last, and a line of up to SHORT words
pairs of the least hashes of its runs of two. A pair with a quarter of its words changed keeps about a quarter of its
runs. Each key holds a class of the number of words, on one of two grids: numbers within a third of each other share a
class of one.

Equal lines are one node. Nodes of a key of up to FULL nodes all meet. Within a larger key each node first meets the two
before it in the order of SimHashes, the first, and the key's hubs. Versions of one line are near it but often not near each other, so hubs are the node nearest to the middle of
the key's SimHashes (the bits that over half of them have) and, as a key may hold versions of several lines, those that lie
closest to their neighbours in that order, the best of each of HUBS classes by hash. So most versions come together by work that grows with the keys and not with the square of a group; a key of very many nodes is dealt into parts
with hubs of their own, and all its nodes also meet the best hubs of all parts. Then, in a second round, nodes of a large key
that are not in one group yet meet: all of a key of up to TILE nodes, those of larger keys where they share one of their rarest words. With e edits allowed, two lines that pass the edit
check share all but e words of the longer one, so one of the e + 1 rarest of each is common to both: no pair that shares a key
is left out for the size of the key, and words that all lines of a key have bring none together. Of these pairs those
whose numbers of words allow it, whose words differ (by a set of 64 bits, which loses none) in no more than the edits allow and whose SimHashes differ in
BITS bits at most are verified by edit similarity over words, each word standing as one of 32,768 characters. Of each connected
group the first occurrence by document and line stays. README has the recall against brute force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components, lookup
from tidemark.llm.scratch import Scratch

MIN_WORDS, SIMILARITY = 5, 0.75
#: Bits that two SimHashes may differ in, by the words of the shorter line: up to 10, up to 20, more. Unrelated lines differ in
#: about 26; random pairs with a quarter of their words changed in 15, on average.
BITS = (28, 25, 22)
#: Runs of three words in a line's sketch; words up to which a line is short, and runs of two in such a line's sketch.
SKETCH, SHORT, TWOS = 11, 10, 6
#: Letters of a long word, and its weight in the SimHash as a power of two; words that one row of the sums holds.
LETTERS, LONG, STEP = 4, 3, 4
#: Words that sums of 14 bits can count; those of longer lines have 30 bits, enough for 2**27 words, more than a row of Spark can hold as an array.
MOST_WORDS = 2000
#: Width of a class of numbers of words, in their logarithm: twice that of 4 / 3 and a little more.
GRID = 0.6
#: Lowest bit and width of each block, of three of which a key has one, and of four of which it has two: two lines within two bits share a key of either kind.
BLOCKS = (((0, 21),), ((21, 21),), ((42, 22),))
PAIRS = tuple(((16 * i, 16), (16 * j, 16)) for j in range(4) for i in range(j))
#: Nodes of a key that are put in one order of SimHashes; keys of more are dealt into parts of about that size.
PART, SAMPLE, HOT = 20_000, 64, 10_000
#: Hubs of a key beside the one in its middle.
HUBS = 3
#: Nodes of a key up to which all its pairs meet at once; nodes of each side of a tile in which those of a larger key meet.
FULL, TILE = 64, 4096
#: What a pair is judged by before its words are read.
NODE = ("node", "sim", "words", "sig")
#: Sets of words by 9 bits of each, in eight numbers, for nodes of large keys: 64 bits are all set by a long line.
SETS = tuple(f"set{j}" for j in range(8))
NULL_LAST = 2**63 - 1
NO_LETTERS = "".join(chr(i) for i in range(128) if not "a" <= chr(i) <= "z")
RUNS = [f"r{j}" for j in range(SKETCH)]


def words_of(line: Column) -> Column:
    """The normal form of a line: its words in lower case, without ASCII punctuation and digits."""
    bare = F.btrim(F.lower(line), F.lit(NO_LETTERS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x00-`{-\x7F]+"))


def _code(word: Column) -> Column:
    """A number for a word: 59 bits of hash above 5 bits of its length."""
    return F.shiftleft(F.xxhash64(word), 5).bitwiseOR(F.least(F.length(word), F.lit(31)).cast("bigint"))


def codes_of(words: Column) -> Column:
    return F.transform(words, _code)


def _twos(code: Column) -> Column:
    """Keys of a short line: pairs among the least hashes of its runs of two words; runs without a long word count last."""

    def rank(code: Column, i: Column) -> Column:
        a, b = F.get(code, i), F.get(code, i + 1)
        return F.shiftleft((a.bitwiseOR(b).bitwiseAND(F.lit(24)) == 0).cast("bigint"), 31).bitwiseOR(F.shiftrightunsigned(F.xxhash64(a, b), 33))

    least = lambda c: F.slice(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: rank(c, i))), 1, TWOS)
    pair = lambda t, i: F.transform(F.slice(t, i + 2, TWOS), lambda y: F.xxhash64(F.get(t, i), y).cast("bigint"))
    all_of = lambda t: F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: pair(t, i)))
    return F.element_at(F.transform(F.array(code), lambda c: F.element_at(F.transform(F.array(least(c)), all_of), 1)), 1)


def line_table(docs: DataFrame, short: bool = False) -> DataFrame:
    """key (of the row), doc, line_no, k1, k2 (of the normal line), words, twos, the SimHash sim, the set of words sig (by 6 bits of each) and the run hashes r0, r1, ... of each line that counts."""
    lines = lambda text: docs.select("key", F.coalesce("doc_id", F.lit(NULL_LAST)).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    usual, long = lines(F.coalesce("text", F.lit(""))), lines(F.when(F.length("text") > 2 * MOST_WORDS, F.col("text")))
    usual = usual.where(F.col("line").rlike(r"[^ \t\r\x0B\x0C]")) if short else usual.where(F.length("line") >= 2 * MIN_WORDS - 1)
    usual = _sketched(usual, 16, F.size("all").between(0 if short else MIN_WORDS, MOST_WORDS))
    return usual.unionByName(_sketched(long.where(F.length("line") > 2 * MOST_WORDS), 32, F.size("all") > MOST_WORDS))


def _sketched(rows: DataFrame, apart: int, those: Column) -> DataFrame:
    """The line table of `those` of the lines `rows` (key, doc, line_no and line); `all` are the words. Counts of bits that lie `apart` share a sum, so a count has as many bits less two."""
    bare = F.btrim("line", F.lit(" \t\r\x0b\x0c"))  # slow, and only of lines without words
    named = lambda *seed: F.when(F.size("all") > 0, F.xxhash64("all", *seed)).otherwise(F.xxhash64(bare, *seed, F.lit("bare")))
    rows = rows.withColumn("all", words_of(F.col("line")))
    by = ["key", "doc", "line_no", "k1", "k2", "words", "twos"]
    rows = rows.select("key", "doc", "line_no", named().alias("k1"), named(F.lit(7)).alias("k2"), F.size("all").alias("words"), F.when(F.size("all").between(MIN_WORDS, SHORT), _twos(codes_of(F.col("all")))).alias("twos"), "all")
    rows = rows.select(*by, "all", F.explode(F.when(those, F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(STEP)))).alias("at"))  # a filter would split the line twice
    rows = rows.select(*by, *(F.when(F.col("at") + i < F.col("words"), _code(F.get("all", F.col("at") + i))).alias(f"c{i}") for i in range(STEP + 2)))
    out = [F.when(F.col(f"c{i}").isNotNull(), F.xxhash64(f"c{i}")) for i in range(STEP)]
    shift = [F.when(F.col(f"c{i}").bitwiseAND(F.lit(31)) >= LETTERS, F.lit(LONG)).otherwise(F.lit(0)) for i in range(STEP)]
    plain = lambda i: F.shiftleft((F.col(f"c{i}").bitwiseOR(F.col(f"c{i + 1}")).bitwiseOR(F.col(f"c{i + 2}")).bitwiseAND(F.lit(24)) == 0).cast("bigint"), 62)
    runs = [F.when(F.col(f"c{i + 2}").isNotNull(), F.xxhash64(f"c{i}", f"c{i + 1}", f"c{i + 2}")) for i in range(STEP)]
    bits = [F.coalesce(F.expr(f"shiftleft(1L, cast(shiftright(c{i}, 5) & 63 as int))"), F.lit(0).cast("bigint")) for i in range(STEP)]
    rows = rows.select(*by, reduce(Column.bitwiseOR, bits).alias("sig"), *(h.alias(f"h{i}") for i, h in enumerate(out)), *(x.alias(f"w{i}") for i, x in enumerate(shift)), *(r.alias(f"r{i}") for i, r in enumerate(runs)), *(plain(i).alias(f"p{i}") for i in range(STEP)))
    add = lambda terms: sum(terms[1:], terms[0])
    count = lambda j: F.sum(add([F.coalesce(F.expr(f"shiftleft(shiftrightunsigned(h{i}, {j}) & {_ones(apart)}L, w{i})"), F.lit(0)) for i in range(STEP)]))
    total = F.sum(add([F.when(F.col(f"h{i}").isNotNull(), F.expr(f"shiftleft(1L, w{i})")).otherwise(0) for i in range(STEP)]))
    least = lambda j: F.min(F.least(*(F.when(F.col(f"r{i}").isNotNull(), F.shiftrightunsigned(F.xxhash64(f"r{i}", F.lit(j)), 2).bitwiseOR(F.col(f"p{i}"))) for i in range(STEP))))
    wide = rows.groupBy(*by).agg(total.alias("n"), F.bit_or("sig").alias("sig"), *(count(j).alias(f"s{j}") for j in range(apart)), *(least(j).alias(r) for j, r in enumerate(RUNS)))
    return wide.select(*by, _over_half([f"s{j}" for j in range(apart)], F.col("n")).alias("sim"), "sig", *RUNS)


def _kind(words: Column, grid: int) -> Column:
    """The class of a number of words on one of two grids."""
    return F.floor(F.log(words.cast("double")) / GRID + grid * 0.5)


def block_keys(sim: Column, words: Column, blocks: tuple = BLOCKS) -> Column:
    part = lambda at, width: F.shiftrightunsigned(sim, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.xxhash64(*(part(*x) for x in key), F.lit(t), _kind(words, t % 2)) for t, key in enumerate(blocks)))


def run_keys(words: Column) -> Column:
    """Keys of a line's least runs and of its pairs of short runs, each with the class of the number of words on one grid or the other."""
    keys = F.array(*(F.when(F.col(r).isNotNull(), F.xxhash64(r, F.lit(j), _kind(words, j % 2))) for j, r in enumerate(RUNS)))
    twos = F.transform("twos", lambda x: F.xxhash64(x, F.when(F.pmod(x, F.lit(2)) == 0, _kind(words, 0)).otherwise(_kind(words, 1))))
    return F.when(F.col("twos").isNull(), keys).otherwise(F.concat(keys, F.array_distinct(twos)))


def as_letters(code: Column) -> Column:
    """A line with one character for each word, by 15 bits of its hash; characters of the range have no surrogates."""
    return F.decode(F.unhex(F.array_join(F.transform(code, lambda c: F.hex(F.shiftright(c, 5).bitwiseAND(F.lit(0x7FFF)) + 0x1000)), "")), "UTF-16BE")


def letters_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, norm) of the nodes of `places`, each read from one line of a document."""
    want = places.groupBy("key").agg(F.collect_list(F.struct("node", "line_no")).alias("want"))
    pick = F.flatten(F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("want", lambda w: F.struct(w["node"].alias("node"), F.get(lines, w["line_no"]).alias("line")))))
    rows = docs.join(want.hint("shuffle_hash"), "key").select(F.explode(pick).alias("x"))
    return rows.select("x.node", as_letters(codes_of(words_of(F.col("x.line")))).alias("norm")).dropDuplicates(["node"])


def word_sets(texts: DataFrame) -> DataFrame:
    """(node, SETS): the set of words of each line of `texts` (node and norm); a word's second occurrence counts as another word."""
    none = F.struct(F.lit("").alias("c"), F.lit(0).alias("i"), *(F.lit(0).cast("bigint").alias(x) for x in SETS))

    def add(old: Column, c: Column) -> Column:
        i = F.when(old["c"] == c, old["i"] + 1).otherwise(F.lit(1))
        code = F.xxhash64(c, i)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), code.bitwiseAND(F.lit(63)).cast("int"))
        at = F.shiftright(code, 6).bitwiseAND(F.lit(7))
        return F.struct(c.alias("c"), i.alias("i"), *(F.when(at == j, old[x].bitwiseOR(bit)).otherwise(old[x]).alias(x) for j, x in enumerate(SETS)))

    words = F.sort_array(F.filter(F.split("norm", ""), lambda c: c != ""))  # a row of words for each line would grow faster than the input, as large keys do
    return texts.select("node", F.aggregate(words, none, add).alias("all")).select("node", *(f"all.{x}" for x in SETS))


def rare_words(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, rare): hashes of the rarest words of each line of `texts`, one more than the edits that it allows; occurrences count as in `word_sets`.

    The order is one for all lines: by how often the word occurs in them, then by the word."""
    all_of = texts.select("node", F.length("norm").alias("n"), F.explode(F.split("norm", "")).alias("c")).where("c <> ''")
    each = all_of.groupBy("node", "n", "c").agg(F.count("*").cast("int").alias("times"))
    often = each.groupBy("c").agg(F.sum("times").alias("often"))  # 32,768 rows at most
    one = each.join(F.broadcast(often), "c").select("node", "n", "often", "c", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i"))
    bags = one.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "c", "i"))).alias("bag"))
    first = F.transform(F.slice("bag", F.lit(1), _most(F.col("n"), similarity) + 1), lambda x: F.xxhash64(x["c"], x["i"]))
    return bags.select("node", F.array_distinct(first).alias("rare"))


def _most(words: Column, similarity: float) -> Column:
    """Edits that a pair may differ in, by the words of the longer line."""
    return F.floor(words * F.lit(1 - similarity) + 1e-9).cast("int")


def _close(other: str, similarity: float) -> Column:
    """Bits to spare, plus one, of a pair that may hold by its numbers and sets of words, which lose none, and by SimHash; else null."""
    more, fewer = F.greatest("words", f"{other}.words"), F.least("words", f"{other}.words")
    bits = F.when(fewer <= SHORT, BITS[0]).when(fewer <= 2 * SHORT, BITS[1]).otherwise(BITS[2])
    spare = bits - F.bit_count(F.col("sim").bitwiseXOR(F.col(f"{other}.sim")))
    ok = F.col(f"{other}.node").isNotNull() & (F.col(f"{other}.node") != F.col("node")) & (fewer >= more * F.lit(similarity) - 1e-9) & (spare >= 0)
    # a word that only one of the two has takes an edit; one bit may stand for several words, so bits count no more than words
    ok = ok & (_alone(other, ("sig",)) <= more * F.lit(1 - similarity) + 1e-9)
    return F.when(ok, spare + 1)


def _alone(other: str, sets: tuple[str, ...]) -> Column:
    """Bits of `sets` that only one of the two has, of the one that has more."""
    count = lambda a, b: reduce(Column.__add__, (F.bit_count(F.col(f"{a}{x}").bitwiseAND(F.bitwise_not(F.col(f"{b}{x}")))) for x in sets))
    return F.greatest(count("", f"{other}."), count(f"{other}.", ""))


def hot_keys(cells: DataFrame) -> DataFrame:
    """(b, parts) of keys with so many nodes that they are dealt out; counted on one node in SAMPLE, as only the dealing depends on it.

    A key counts as hot beyond PART nodes; there are HOT of them at most, those with the most nodes."""
    some = cells.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    counts = some.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > PART / SAMPLE)
    return counts.orderBy(F.desc("n"), "b").limit(HOT).select("b", F.ceil(F.col("n") * SAMPLE / PART).alias("parts"))


def _ones(apart: int) -> int:
    """The lowest bit of each of the counts that share a sum."""
    return sum(1 << at for at in range(0, 64, apart))


def _over_half(sums: list[str], n: Column) -> Column:
    """64 bits, each set where its count is over half of n; of 16 sums, sum j packs the counts of bits j, j + 16, j + 32 and j + 48, all below 2**14, of 32 sums those of bits j and j + 32, up to 2**30."""
    apart, top = len(sums), len(sums) - 2
    # adding 2**14 - 1 - n / 2 to each count sets bit 14 where it is over half
    rest = (F.lit((1 << top) - 1).cast("bigint") - F.shiftright(n, 1)) * F.lit(_ones(apart))
    over = lambda j, x: F.shiftleft(F.shiftrightunsigned((F.col(x) + rest).bitwiseAND(F.lit(_ones(apart) << top)), top), j)
    sim = over(0, sums[0])
    for j, x in enumerate(sums[1:], 1):
        sim = sim.bitwiseOR(over(j, x))
    return sim


def _hubs() -> list[Column]:
    """The hubs of a key: the node nearest to the middle of its SimHashes, and of each class the one nearest to its neighbours."""
    best = [F.max(F.when((F.col("score") > 0) & (F.pmod(F.xxhash64("node"), F.lit(HUBS)) == k), F.struct("score", *NODE))) for k in range(HUBS)]
    return [F.min(F.struct("off", *NODE)), *best]


def _placed(cells: DataFrame, similarity: float) -> DataFrame:
    """Cells of keys of several nodes, with the two before (x1, x2) and after (y1, y2), the first, the score of nearness to those
    beside it and the distance `off` from the middle of the key's SimHashes."""
    order, whole = Window.partitionBy("b").orderBy("sim", "node"), Window.partitionBy("b")  # one exchange and one sort serve both
    me = F.struct(*NODE)
    out = cells.select("*", *(F.lag(me, i).over(order).alias(f"x{i}") for i in (1, 2)), *(F.lead(me, i).over(order).alias(f"y{i}") for i in (1, 2)), F.first(me).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    out = out.where("x1 is not null or y1 is not null").withColumn("all", F.count("*").over(whole))
    mine = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / (PART // 2))) == 0  # of a key that is larger than its part should be, a share by hash, so that counts stay below 2**14
    sums = [F.sum(F.when(mine, F.expr(f"shiftrightunsigned(sim, {j}) & {0x0001000100010001}L"))).over(whole).alias(f"s{j}") for j in range(16)]
    out = out.select("*", *sums, F.count(F.when(mine, 1)).over(whole).alias("n"))
    spare = [F.coalesce(_close(x, similarity), F.lit(0)) for x in ("x1", "x2", "y1", "y2")]
    off = F.bit_count(F.col("sim").bitwiseXOR(_over_half([f"s{j}" for j in range(16)], F.col("n"))))
    return out.select(*cells.columns, "x1", "x2", "first", sum((x * x for x in spare), F.lit(0)).alias("score"), off.alias("off"))


def shared_keys(scratch: Scratch, unique: DataFrame) -> DataFrame:
    """Nodes by key, of keys of several nodes: key, b (a part of a hot key, else the key), parts (of a hot key, else null), n (nodes of b) and NODE."""
    keys = F.concat(block_keys(F.col("sim"), F.col("words"), PAIRS), run_keys(F.col("words")))
    cells = unique.where(F.col("words") >= MIN_WORDS).select("node", F.explode(keys).alias("key")).where("key is not null")  # most keys have one node, so the rest of it comes later
    hot = scratch.save(hot_keys(cells.withColumnRenamed("key", "b")).withColumnRenamed("b", "key"))
    if hot.isEmpty():
        shared = cells.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("node", "key", F.lit(None).cast("bigint").alias("parts"), F.col("key").alias("b"), "n")
    else:
        at = cells.join(F.broadcast(hot), "key", "left")  # at most HOT rows
        at = at.withColumn("b", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts"))))
        shared = at.withColumn("n", F.count("*").over(Window.partitionBy("b"))).where("n > 1 or parts is not null")
    return scratch.save(shared.join(unique.select(*NODE), "node"))


def first_pairs(scratch: Scratch, cells: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v), u > v: all of keys of up to FULL nodes, at most 5 + 2 * HUBS for each node of a larger key; `rest` has the others."""
    ordered = lambda df, other: df.select(F.greatest("node", other).alias("u"), F.least("node", other).alias("v"))
    few = cells.where((F.col("n") <= FULL) & F.col("parts").isNull()).select("b", *NODE)
    both = few.alias("a").join(few.alias("x"), F.expr("a.b = x.b and a.node > x.node"))  # of one exchange
    both = both.select(*(F.col(f"a.{c}").alias(c) for c in NODE), F.struct(*(F.col(f"x.{c}").alias(c) for c in NODE)).alias("x"))
    pairs = ordered(both.where(_close("x", similarity).isNotNull()), "x.node")

    def near(df: DataFrame, others: tuple[str, ...]) -> DataFrame:
        """Of all keys of a node the others that it may equal, each once."""
        some = df.select("node", F.array_compact(F.array(*(F.when(_close(x, similarity).isNotNull(), F.col(f"{x}.node")) for x in others))).alias("others"))
        some = some.where(F.size("others") > 0).groupBy("node").agg(F.flatten(F.collect_list("others")).alias("others"))
        return ordered(some.select("node", F.explode(F.array_distinct("others")).alias("other")), "other")

    hubs = [f"hub{k}" for k in range(HUBS + 1)]
    many = cells.where((F.col("n") > FULL) | F.col("parts").isNotNull())
    if many.isEmpty():
        return pairs.distinct()
    found = _placed(many.select("b", *NODE), similarity)
    found = found.select("*", *(h.over(Window.partitionBy("b")).alias(x) for x, h in zip(hubs, _hubs(), strict=True)))
    pairs = pairs.unionByName(near(found, ("x1", "x2", "first", *hubs)))
    dealt = cells.where("parts is not null")
    if not dealt.isEmpty():
        parts = _placed(dealt.select("b", "key", *NODE), similarity)
        best = scratch.save(parts.groupBy("key").agg(*(h.alias(x) for x, h in zip(hubs, _hubs(), strict=True))))
        pairs = pairs.unionByName(near(dealt.join(F.broadcast(best), "key"), hubs))  # one row for each hot key
    return pairs.distinct()


def candidates(scratch: Scratch, unique: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v), u > v, of nodes that share a key, as far as the first round has them."""
    return first_pairs(scratch, shared_keys(scratch, unique), similarity)


def rest(scratch: Scratch, cells: DataFrame, comps: DataFrame, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """All pairs (u, v), u > v, that share a key of over FULL nodes and are in different components (node, component) yet.

    With `texts` (node and norm of these nodes) only pairs whose sets of words allow the similarity, and nodes of a key of over TILE nodes meet only where they
    share a rare word, which all pairs of the similarity do."""
    large = cells.where((F.col("n") > FULL) | F.col("parts").isNotNull()).select("key", *NODE)
    large = scratch.save(large.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    nodes, keys = large.select(*NODE).distinct(), scratch.save(_several(large))
    if texts is None:
        return _met(large, keys, nodes, similarity)
    some = scratch.save(lookup(large.select("key", "node", "comp"), keys.select("key", "all", (F.col("all") > TILE).alias("many")), ["key"], "all"))
    of = some.groupBy("node").agg(F.collect_list("key").alias("keys"))
    texts = texts.join(of.select("node"), "node", "left_semi")
    nodes = scratch.save(nodes.join(of, "node").join(word_sets(texts), "node"))
    pairs = _met(some.where("not many"), keys.where(F.col("all") <= TILE), nodes, similarity, (*SETS, "keys"))
    if (many := some.where("many")).isEmpty():
        return pairs
    rare = scratch.save(rare_words(texts.join(many.select("node").distinct(), "node", "left_semi"), similarity))
    words = scratch.save(many.join(rare, "node").select(F.explode(F.transform("rare", lambda w: F.xxhash64("key", w))).alias("key"), "node", "comp"))
    return pairs.unionByName(_met(words, scratch.save(_several(words)), nodes, similarity, SETS)).distinct()


def _several(rows: DataFrame) -> DataFrame:
    """Keys of several components of `rows` (key, node, comp): chief (the largest), most (its nodes) and all."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.max_by("comp", "n").alias("chief"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")


def _met(rows: DataFrame, keys: DataFrame, nodes: DataFrame, similarity: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (u, v), u > v, of `rows` (key, node, comp) that share one of `keys` (as of `_several`), are in different components and may hold by NODE and `more` of `nodes`.

    Nodes outside the largest component of a key meet each other and those in it, each block of TILE in one group of a join with each other
    block, so no task holds a key; nodes of the largest component need not meet. With the `keys` of the nodes a pair counts in the first that it shares."""
    blocks = {"inner": F.ceil(F.col("most") / TILE).cast("int"), "outer": F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")}
    at = lookup(rows.select("key", "node", "comp"), keys.withColumns(blocks).drop("most"), ["key"], "all").withColumn("in", F.col("comp") == F.col("chief"))
    at = at.join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    others = lambda chief, low, high: F.transform(F.sequence(low, F.col(high) - 1), lambda j: F.struct(F.lit(chief).alias("chief"), j.alias("j")))
    met = F.concat(others(False, F.col("block"), "outer"), others(True, F.lit(0), "inner"))
    left = at.where("not in").select("key", F.col("block").alias("i"), F.explode(met).alias("to"), "comp", *NODE, *more).select("key", "i", "to.chief", "to.j", "comp", *NODE, *more)
    last = F.when(F.col("in"), F.col("outer") - 1).otherwise(F.col("block"))
    right = at.select("key", F.explode(F.sequence(F.lit(0), last)).alias("i"), F.col("in").alias("chief"), F.col("block").alias("j"), F.struct("comp", *NODE, *more).alias("x"))
    both = left.join(right, ["key", "i", "chief", "j"]).where("comp <> x.comp and (chief or i < j or node > x.node)").where(_close("x", similarity).isNotNull())
    if more:
        both = both.where(_alone("x", SETS) <= _most(F.greatest("words", "x.words"), similarity))
    if "keys" in more:
        both = both.where(F.col("key") == F.array_min(F.array_intersect("keys", "x.keys")))
    return both.select(F.greatest("node", "x.node").alias("u"), F.least("node", "x.node").alias("v")).distinct()


def merged(scratch: Scratch, comps: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) once the ends of `edges` (u, v) are in one; only components take part, not their nodes."""
    both = edges
    for end in ("u", "v"):
        both = both.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).drop(f"{end}_in")
    now = components(scratch, both).select(F.col("node").alias("component"), F.col("component").alias("least"))
    alone = now.join(comps.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))  # of one node so far
    return comps.join(now, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(alone)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose words have 1 - distance / longer length at `similarity` or more; `texts` has node and norm."""
    a, b = texts.select(F.col("node").alias("u"), F.col("norm").alias("a")), texts.select(F.col("node").alias("v"), F.col("norm").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("most", _most(F.greatest(F.length("a"), F.length("b")), similarity))
    return both.where(F.abs(F.length("a") - F.length("b")) <= F.col("most")).where(F.expr("levenshtein(a, b, most)") >= 0).select("u", "v")


def removed_lines(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, short: bool = False) -> DataFrame:
    """(key, line_no) of each line that is not the first of its group; `docs` has key, doc_id and text."""
    lines = scratch.save(line_table(docs.repartition("key"), short))
    at = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")  # one number orders occurrences, so that sums stay in hash tables
    alike = ["k1", "k2", "words", "sim", "sig", "twos", *RUNS]  # what equal lines share
    rows = lines.select(*alike, "key", "line_no", at.cast("decimal(38,0)").alias("at"))
    unique = rows.groupBy(*alike).agg(F.min("at").alias("at"), F.min_by("key", "at").alias("key"), F.min_by("line_no", "at").alias("line_no"), F.count("*").alias("n"))
    unique = scratch.save(unique.withColumn("node", F.monotonically_increasing_id()))
    full, lines = lines, scratch.save(lines.select("k1", "k2", "key", "line_no"))
    scratch.drop(full)

    cells = shared_keys(scratch, unique)
    full, unique = unique, scratch.save(unique.select("k1", "k2", "n", "at", "key", "line_no", "node"))
    scratch.drop(full)
    pairs = scratch.save(first_pairs(scratch, cells, similarity))
    large = cells.where((F.col("n") > FULL) | F.col("parts").isNotNull()).select("node").distinct()
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(large).distinct()
    texts = scratch.save(letters_of(docs, unique.select("node", "key", "line_no").join(nodes, "node", "left_semi")))  # of both rounds, so documents are read once
    comps = scratch.save(components(scratch, edges := scratch.save(verified(pairs, texts, similarity))))
    scratch.drop(pairs, edges)
    if not large.isEmpty():
        more = scratch.save(rest(scratch, cells, comps, similarity, texts))
        if not (new := scratch.save(verified(more, texts, similarity))).isEmpty():
            comps = merged(scratch, comps, new)
    scratch.drop(texts)
    scratch.drop(cells)
    named = unique.select("k1", "k2", "n", "at", "key", "line_no", "node").join(comps, "node", "left").where("n > 1 or component is not null")
    named = scratch.save(named.select("k1", "k2", "n", "at", "key", "line_no", F.coalesce("component", "node").alias("comp")))
    groups = scratch.save(named.groupBy("comp").agg(F.min_by("key", "at").alias("chief"), F.min_by("line_no", "at").alias("chief_line"), F.count("*").alias("nodes")))
    chiefs = scratch.save(lookup(named.select("k1", "k2", "n", "comp"), groups, ["comp"], "nodes").select("k1", "k2", "n", "chief", "chief_line"))
    found = lookup(lines, chiefs, ["k1", "k2"], "n")
    return found.where("key <> chief or line_no <> chief_line").select("key", "line_no")


def dedup_lines(docs: DataFrame, *, similarity: float = SIMILARITY, columns: bool = True, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed and kept, the text that is left, of each row; with `columns` also the struct `row`.

    Null texts stay null and have no lines; empty ones have one empty line. With `short`, lines of under
    MIN_WORDS words that an earlier line equals go too (blank ones never); else they always stay.
    Null ids come last among occurrences. Of rows of one id and text the lines go from both or from neither. An empty
    table gives an empty result. Other columns are not read and may have any names."""
    scratch = Scratch(docs.sparkSession, "lines")
    key = F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("key")
    texts = docs.select(key, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gone = scratch.save(removed_lines(texts, scratch, similarity, short).groupBy("key").agg(F.collect_set("line_no").alias("gone")))
    rows = docs.select(key, F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([F.struct("*").alias("row")] if columns else []))
    out = rows.join(gone.hint("shuffle_hash"), "key", "left")
    split = F.split("text", "\n")
    left = lambda x: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone"), lambda i: F.get(x, i)))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(split), left), 1))
    return out.select(*(["row"] if columns else []), "doc_id", F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), kept.alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=False, short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
