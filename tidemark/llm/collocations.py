"""Operator 11: phrase collocations by SON partitioning.

Documents are dealt into SHARDS shards by hash of their id. A phrase with `least` occurrences has least / SHARDS of them,
rounded up, in one shard at least, so each shard is mined completely at that lower support, one after the other, and
the locally frequent phrases are put together, but for those that cannot reach `least` even with the most occurrences
that the other shards may have left unseen. For that phrases are 64-bit hashes: two phrases that share one can only
add to what is mined. A second pass then counts the candidates over all shards by their words, exactly; what the first
pass let through by chance is counted too and falls below `least`.

Tasks number their words, so equality of phrases inside a task is equality of words, and send one row for each phrase
and BLOCK words, however often it occurs. The candidates reach the second pass as a bitmap of fixed size. Where a corpus
fills it, the second pass counts more phrases than it must, and the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.kernels import U
from tidemark.llm.scratch import Scratch, deploy

#: Words of the longest phrase, occurrences of a candidate, shards, and results for each language.
LONGEST, LEAST, SHARDS, TOP = 3, 10, 4, 2000
#: A phrase goes if 100 * f(longer) >= COVER * a.
COVER = 50
#: Words counted together, distinct words that a task holds, and bytes of text taken at once.
BLOCK, VOCABULARY, TEXT_BLOCK = 400_000, 200_000, 1 << 20
#: Rows that a task sends at once.
ROWS = 50_000
#: Bits of the bitmap of candidates (16 MB, whatever the corpus), and of one of Spark's bitmaps.
BITS, BUCKET = 1 << 27, 32768
NEXT = U(0x9E3779B97F4A7C15)
#: A byte that no UTF-8 text holds stands for the ends of pieces; tabs become spaces, A-Z a-z.
END = b"\xff"
FOLD = bytes(END[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Phrases:
    """Occurrences of the phrases of one task, by numbers of words. A phrase counts where its last word comes in, so texts may come in parts."""

    def __init__(self):
        self.tail = np.zeros((2, 0), np.int64)
        self._anew()

    def _anew(self) -> None:
        self.langs: dict[str, int] = {}
        self.words: dict[bytes, int] = {END: 0}
        self.held, self.size = [], 0

    def add(self, lang: str, text: bytes) -> bool:
        """Takes folded text; whether it is time to count."""
        words, number = text.replace(END, b" \xff ").split(), self.words
        ids = np.empty((2, len(words)), np.int64)
        ids[0] = self.langs.setdefault(lang, len(self.langs))
        ids[1] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        self.held.append(ids)
        self.size += len(words)
        return self.size >= BLOCK or len(number) > VOCABULARY

    def end(self) -> None:
        """Ends a text."""
        self.held.append(np.zeros((2, 1), np.int64))

    def counted(self, longest: int):
        """(words, languages, levels), then starts anew. A level has, for each phrase of its length, language, numbers of
        the words, hash, place of the phrase without its last word in the level before, and count."""
        fresh, old = np.concatenate([self.tail, *self.held], 1), self.tail.shape[1]
        words, langs, (lang, ids) = list(self.words), list(self.langs), fresh
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), U, len(langs))
        levels, whole, code, h, shown = [], np.ones(len(ids), bool), lang, k.mix(seeds), (np.arange(len(langs)), np.zeros((len(langs), 0), np.int64))
        for n in range(1, longest + 1):
            at = np.flatnonzero(ids > 0) if n == 1 else np.flatnonzero(whole[:-1] & (ids[1:] > 0)) + 1
            before = code[at] if n == 1 else code[at - 1]
            both, inverse = np.unique(before * len(words) + ids[at], return_inverse=True)
            prev, last = both // len(words), both % len(words)
            h = k.mix(h[prev] * NEXT + hashes[last])
            shown = shown[0][prev], np.concatenate([shown[1][prev], last[:, None]], 1)
            levels.append((*shown, h, prev, np.bincount(inverse[at >= old], minlength=len(both))))
            whole, code = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            whole[at], code[at] = True, inverse
        self.tail = fresh[:, max(0, len(ids) - longest + 1) :]
        self._anew()
        for j, (x, w) in enumerate(self.tail.T):
            self.tail[:, j] = (self.langs.setdefault(langs[x], len(self.langs)), self.words.setdefault(words[w], len(self.words))) if w else (0, 0)
        return words, langs, levels


def _parts(text: bytes):
    """The text in parts of about TEXT_BLOCK bytes that end behind a word."""
    lo = 0
    while len(text) - lo > TEXT_BLOCK:
        cut = max(text.rfind(b" ", lo, lo + TEXT_BLOCK), text.rfind(END, lo, lo + TEXT_BLOCK))
        if cut < lo:
            ends = [i for i in (text.find(b" ", lo), text.find(END, lo)) if i >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[lo : cut + 1]
        lo = cut + 1
    yield text[lo:]


def _counts(batches, longest: int):
    """Counts of runs of texts, as Phrases gives them."""
    phrases = Phrases()
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column(1)[i].as_py() or b"").translate(FOLD)
            for part in _parts(text):
                if phrases.add(batch.column(0)[i].as_py(), part):
                    yield phrases.counted(longest)
            phrases.end()
    yield phrases.counted(longest)


def _mined(longest: int):
    def run(batches):
        for _, _, levels in _counts(batches, longest):
            for _, _, h, _, count in levels:
                yield pa.record_batch([pa.array(h[count > 0].view(np.int64)), pa.array(count[count > 0], pa.int64())], names=["h", "c"])

    return run


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both places of each hash are set."""
    out = np.ones(len(h), bool)
    for shift in (0, 32):
        at = (h >> U(shift)) & U(BITS - 1)
        out &= (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
    return out


def _tallied(bitmap, longest: int):
    """Counts of the candidates by their words, and the number of all words of each language (size 0)."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for words, langs, levels in _counts(batches, longest):
            text, kept = [w.decode() for w in words[1:]], np.ones(len(langs), bool)
            total = np.bincount(levels[0][0], levels[0][4], len(langs)).astype(np.int64)
            yield _rows(langs, [0] * len(langs), [""] * len(langs), total)
            for n, (lang, ids, h, prev, count) in enumerate(levels, 1):
                kept = kept[prev] & _held(bits, h)
                found = np.flatnonzero(kept & (count > 0))
                for lo in range(0, len(found), ROWS):
                    some = found[lo : lo + ROWS]
                    yield _rows([langs[i] for i in lang[some]], [n] * len(some), [" ".join([text[w - 1] for w in row]) for row in ids[some].tolist()], count[some])

    return run


def _rows(lang, size, phrase, count) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(count, pa.int64())], names=["lang", "size", "phrase", "c"])


def _bitmap(hashes: DataFrame) -> bytes:
    """BITS bits, with those of all hashes set; built by Spark, 4 KB for each of a fixed number of groups."""
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITS - 1))).alias("at"))
    out = bytearray(BITS // 8)
    for r in places.groupBy(F.expr(f"at div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET).alias("bits")).toLocalIterator():
        out[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = r["bits"]
    return bytes(out)


def phrase_counts(docs: DataFrame, scratch: Scratch, *, longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, size, phrase, c: all phrases of up to `longest` words with at least `least` occurrences; size 0 has all words of a language."""
    spark = docs.sparkSession
    deploy(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"))
    lower, mined = -(-least // shards), []
    for shard in range(shards):
        found = rows.where(F.col("shard") == shard).select("lang", "text").mapInArrow(_mined(longest), "h bigint, c bigint")
        mined.append(scratch.save(found.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= lower)))
    union = mined[0]
    for m in mined[1:]:
        union = union.unionByName(m)
    # where a phrase was not found it has lower - 1 occurrences at most, so some cannot come to `least` in all
    union = union.groupBy("h").agg((F.sum("c") + (shards - F.count("*")) * (lower - 1)).alias("most")).where(F.col("most") >= least)
    bitmap = spark.sparkContext.broadcast(_bitmap(union))
    tallied = rows.select("lang", "text").mapInArrow(_tallied(bitmap, longest), "lang string, size int, phrase string, c bigint")
    out = scratch.save(tallied.groupBy("lang", "size", "phrase").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.col("size") == 0)))
    scratch.drop(*mined)
    bitmap.unpersist()
    return out


def _words(phrase: Column, start, size) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), start, size), " ")


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, top: int = TOP, cover: int = COVER, **columns: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score, then a, then the phrase's bytes.

    Null texts are empty, a null language is `und`, null and repeated ids only decide the shard. Other columns are not
    read. Texts of any length are taken in parts; a text without spaces is one word. An empty table gives an empty
    result. `score` is exact up to 10**16 occurrences (38 digits)."""
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, scratch, longest=longest, least=least, shards=shards, **columns)
    known = counts.where("size > 0").select("lang", "phrase", "c")
    cand = counts.where("size > 1").select("lang", "phrase", "size", F.col("c").alias("a"))
    # the lowest cut
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"first": _words(F.col("phrase"), F.lit(1), F.col("k")), "rest": _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))})
    cut = cut.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumn("score", F.call_function("div", (exact("a") * exact("a")).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)")))
    lowest = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # what longer candidates cover
    inner = cand.where("size > 2").withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    longer = inner.select("lang", _words(F.col("phrase"), F.col("start"), F.col("part")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.lit(cover) * F.col("a")))
    # the first of each language, first by parts of it
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    left = left.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    few = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3 FROM t WINDOW z AS (PARTITION BY id ORDER BY i)),
tot AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.a, 1 AS k, x.a AS l, y.a AS r FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, x.a, y.a FROM f3 JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, x.a, y.a FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cut),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3) GROUP BY ALL),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""
