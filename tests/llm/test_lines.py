import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import lines
from tidemark.llm.lines import LETTERS, LONG, MIN_WORDS, MOST_WORDS, SIMILARITY, as_letters, block_keys, codes_of, dedup_lines, line_table, removed_lines, words_of
from tidemark.llm.scratch import Scratch


def norm(line):
    return re.sub(r"[\x00-`{-\x7f]+", " ", line.lower()).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def planted():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, hot = [line(rnd.randrange(6, 40)) for _ in range(60)], line(30)
    docs = []
    for i in range(120):
        some = [rnd.choice(base) for _ in range(2)] + [line(12), "short one", ""]
        if i % 3 == 0:  # variants of one line, all different
            w = hot.split()
            w[rnd.randrange(len(w))] = rnd.choice(words)
            some.append(" ".join(w))
        if i % 4 == 0:
            some.append(rnd.choice(base).upper() + f", {i}!")
        rnd.shuffle(some)
        docs.append((i, "\n".join(some)))
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 50_000 + " a b c d e f"), (None, docs[3][1]), (7, docs[7][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, n_lines int, key string")


def test_groups(spark):
    rows = planted()
    out = {}
    for r in dedup_lines(frame(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    seen, lost = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        r = out[i][0]
        if text is None:
            assert r["kept"] is None and r["n_lines"] == 0
            continue
        lines, kept = text.split("\n"), r["kept"].split("\n") if r["kept"] else ([] if r["n_removed"] == r["n_lines"] else [""])
        assert len(lines) == r["n_lines"] and len(kept) in (len(lines) - r["n_removed"], 1)
        left = list(kept)
        for x in lines:
            if left and left[0] == x:
                left.pop(0)
                if len(norm(x).split()) >= MIN_WORDS:
                    seen.append(norm(x))
            else:  # whatever goes is near some other line that stays, or a chain of them
                lost += 1
                assert len(norm(x).split()) >= MIN_WORDS
        assert not left
    assert lost > 150
    assert len([s for s in seen if rows[7][1] and s in {norm(x) for x in rows[7][1].split("\n")}]) <= 12
    exact = [s for s in seen]
    assert len(set(exact)) >= len(exact) - 8, "equal lines stay once (rows of one id and text go together)"
    base = max(set(seen), key=lambda s: sum(len(set(s.split()) & set(o.split())) > 25 for o in seen))
    hot = [s for s in set(seen) if len(set(s.split()) & set(base.split())) > 25]
    assert len(hot) <= 2, hot


def test_simhash(spark):
    text = "one two three four five six"
    got = line_table(frame(spark, [(1, text)]).withColumn("key", F.lit(1))).first()
    wide = line_table(frame(spark, [(1, (text + " ") * 200)]).withColumn("key", F.lit(1))).first()
    assert wide["sim"] == got["sim"] and wide["words"] == 200 * got["words"]
    most = line_table(frame(spark, [(1, (text + " ") * MOST_WORDS)]).withColumn("key", F.lit(1))).first()
    assert most["words"] == 6 * MOST_WORDS
    one = spark.createDataFrame([(text,)], "line string").select(F.explode(codes_of(words_of(F.col("line")))).alias("c")).select(F.xxhash64("c").alias("h"), F.col("c").bitwiseAND(F.lit(31)).alias("n"))
    h = [(r["h"] % 2**64, 2**LONG if r["n"] >= LETTERS else 1) for r in one.collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(w * (x >> b & 1) for x, w in h) > sum(w for _, w in h))
    assert got["sim"] % 2**64 == want
    assert len(set(spark.range(1).select(block_keys(F.lit(got["sim"]), F.lit(6)).alias("k")).first()["k"])) == 3


def test_long_lines_of_few_words(spark):
    """A word repeated beyond the sums' 14 bits must not carry into its neighbours' counts, nor overflow."""
    words = ["ab", "word", "junk", "longer", "etaoin", "zzz"]
    rows = [(i, " ".join([w] * 9000)) for i, w in enumerate(words)] + [(i + 10, " ".join([w] * 5)) for i, w in enumerate(words)]
    got = {r["doc"]: r["sim"] for r in line_table(frame(spark, rows).withColumn("key", F.col("doc_id"))).collect()}
    assert len(got) == 12 and all(got[i] == got[i + 10] for i in range(6))
    rnd = random.Random(5)
    text = [rnd.choice(words) for _ in range(5000)]
    gone = dedup_lines(frame(spark, [(1, " ".join(text)), (2, " ".join(["new", *text]))]), columns=False).where("n_removed = 1").collect()
    assert [r["doc_id"] for r in gone] == [2]


def test_simhash_of_long_lines(spark):
    """All words of a line count, however many they are."""
    rnd = random.Random(23)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (MOST_WORDS, MOST_WORDS + 1, 3 * MOST_WORDS + 7)]
    got = {r["doc"]: r for r in line_table(frame(spark, list(enumerate(texts))).withColumn("key", F.col("doc_id"))).collect()}
    code = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.element_at(codes_of(F.array("w")), 1).alias("c")).select("w", F.xxhash64("c").alias("h"), F.col("c").bitwiseAND(F.lit(31)).alias("n"))
    code = {r["w"]: (r["h"] % 2**64, 2**LONG if r["n"] >= LETTERS else 1) for r in code.collect()}
    for i, text in enumerate(texts):
        h = [code[w] for w in text.split()]
        want = sum(1 << b for b in range(64) if 2 * sum(w * (x >> b & 1) for x, w in h) > sum(w for _, w in h))
        assert got[i]["words"] == len(h) and got[i]["sim"] % 2**64 == want


def test_letters(spark):
    r = spark.range(1).select(as_letters(F.array(*(F.lit(w << 5).cast("bigint") for w in (0, 32767, 0)))).alias("x"), as_letters(F.array().cast("array<bigint>")).alias("y")).first()
    assert len(r["x"]) == 3 and r["x"][0] == r["x"][2] != r["x"][1] and r["y"] == ""


def test_empty(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_recall_of_changed_words(spark):
    """Every pair that the edit check allows should be found: one word or up to a quarter of the words changed, in any place, by words of any or of equal length."""
    rnd = random.Random(11)
    word = lambda n=0: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n or rnd.randrange(2, 11)))
    docs, kind = [], []
    for low, high in ((5, 8), (9, 12), (13, 20), (21, 35), (36, 60)):
        for share in ("one", "one of equal length", 0.1, 0.2, 0.25):
            for _ in range(100):
                a = [word() for _ in range(rnd.randint(low, high))]
                b = list(a)
                for j in rnd.sample(range(len(a)), 1 if isinstance(share, str) else max(1, int(len(a) * share))):
                    b[j] = word(len(a[j]) if share == "one of equal length" else 0)
                docs += [(2 * len(kind), " ".join(a)), (2 * len(kind) + 1, " ".join(b))]
                kind.append((low, high, str(share)))
    found = {r["doc_id"] // 2 for r in dedup_lines(frame(spark, docs), columns=False).where("n_removed = 1").collect()}
    recall = {k: sum(kind[i] == k for i in found) for k in set(kind)}
    print("pairs found of 100, by words and share changed:", sorted(recall.items()))
    assert min(recall.values()) >= 90 and len(found) >= 0.97 * len(kind), recall


def test_many_versions_of_one_line(spark):
    """Versions that are near their original (similarity 0.79) but rarely near each other: however many there are, one line of each group stays."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 11)))
    docs, want = [], {}
    for versions, originals in ((1, 60), (5, 20), (20, 8), (100, 3), (500, 1)):
        want[versions] = versions * originals
        for _ in range(originals):
            line = [word() for _ in range(24)]
            docs.append((versions, " ".join(line)))
            for _ in range(versions):
                new = list(line)
                for j in rnd.sample(range(24), 5):
                    new[j] = word()
                docs.append((versions, " ".join(new)))
    rnd.shuffle(docs)
    rows = [(i, text) for i, (_, text) in enumerate(docs)]
    gone = dedup_lines(frame(spark, rows), columns=False).where("n_removed = 1").collect()
    got = {v: sum(docs[r["doc_id"]][0] == v for r in gone) for v in want}
    print("versions: lines that went, of those that should:", {v: (got[v], want[v]) for v in want})
    assert all(0.9 * want[v] <= got[v] <= want[v] for v in want), (got, want)


def test_versions_in_split_keys(spark, monkeypatch):
    """Keys of many nodes are dealt into parts; a line still meets the hubs of all parts."""
    monkeypatch.setattr(lines, "PART", 100)
    monkeypatch.setattr(lines, "SAMPLE", 1)
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 11)))
    line = [word() for _ in range(24)]
    rows = [(0, " ".join(line))]
    for i in range(600):
        new = list(line)
        for j in rnd.sample(range(24), 4):
            new[j] = word()
        rows.append((i + 1, " ".join(new)))
    scratch = Scratch(spark, "test")
    nodes = line_table(frame(spark, rows).withColumn("key", F.col("doc_id"))).withColumn("node", F.col("doc"))
    keys = F.concat(block_keys(F.col("sim"), F.col("words")), lines.run_keys(F.col("words")))
    hot = lines.hot_keys(nodes.select("node", "sim", "words", F.explode(keys).alias("b"))).collect()
    assert hot and all(r["parts"] > 1 for r in hot)
    pairs = lines.candidates(scratch, nodes, SIMILARITY).collect()
    assert len({r["u"] for r in pairs if r["v"] == 0}) >= 0.9 * 600, "versions that meet their original"
    assert len(pairs) == len(set(map(tuple, pairs))) and all(r["u"] > r["v"] for r in pairs)


def test_large_keys_meet_in_full(spark, monkeypatch):
    """Every pair of a key that the bounds allow meets, in the first round or, in different components yet, in the second, whatever the key's size."""
    monkeypatch.setattr(lines, "TILE", 30)
    rnd = random.Random(17)
    sims = [rnd.getrandbits(64) for _ in range(200)]
    sims += [x ^ (1 << 63 | 1 << 30 | 1 << 3) for x in sims[:20]]  # near, but far off in the order and in no block of bits equal
    rows = [(i, x - (1 << 64) if x >> 63 else x, 20, 0, 5) for i, x in enumerate(sims)]
    unique = spark.createDataFrame(rows, "node long, sim long, words int, sig long, r0 long")
    unique = unique.select("*", F.lit(None).cast("array<bigint>").alias("twos"), *(F.lit(None).cast("bigint").alias(r) for r in lines.RUNS[1:]))
    want = {(i, j) for i in range(220) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= lines.BITS[1]}
    scratch = Scratch(spark, "test")
    cells = lines.shared_keys(scratch, unique)
    first = {tuple(r) for r in lines.first_pairs(scratch, cells, SIMILARITY).collect()}
    assert first < want and not {(200 + i, i) for i in range(20)} <= first
    none = spark.createDataFrame([], "node long, component long")
    assert first | {tuple(r) for r in lines.rest(scratch, cells, none, SIMILARITY).collect()} == want
    comps = spark.createDataFrame([(i, 0) for i in range(120)] + [(i, 120) for i in range(120, 150)], "node long, component long")
    group = [0] * 120 + [120] * 30 + list(range(150, 220))
    assert {tuple(r) for r in lines.rest(scratch, cells, comps, SIMILARITY).collect()} == {(i, j) for i, j in want if group[i] != group[j]}


def test_lines_with_a_common_part_do_not_all_meet(spark, monkeypatch):
    """Lines of one key that share much, but less than the similarity asks for, meet where they share a rare word, not each with each; near ones are found."""
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 11)))
    head = [word() for _ in range(24)]
    texts = [head + [word() for _ in range(16)] for _ in range(300)]
    for i in range(20):
        new = list(texts[i])
        for j in rnd.sample(range(24, 40), 6):
            new[j] = word()
        texts.append(new)
    met, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    gone = removed_lines(frame(spark, rows).withColumn("key", F.col("doc_id")), Scratch(spark, "test"))
    assert {r["key"] for r in gone.collect()} == set(range(300, 320))
    print("pairs by round:", met)
    assert len(met) == 2 and met[1] < 0.02 * 320 * 319 / 2, met


def test_lines_far_apart_share_no_block(spark):
    """Unrelated SimHashes that agree in a third of their bits, as ever more do in larger tables, make no rows of keys; those within two bits share a key."""
    rnd = random.Random(29)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low = rnd.getrandbits(21)
    sims = [rnd.getrandbits(43) << 21 | low for _ in range(300)]
    near = [sims[i] ^ (1 << a | 1 << b) for i, (a, b) in enumerate([(0, 1), (0, 63), (15, 16), (31, 48), (5, 40), (17, 62), (33, 34)])]
    unique = spark.createDataFrame([(i, signed(x), 20, 0) for i, x in enumerate([*sims, *near])], "node long, sim long, words int, sig long")
    unique = unique.select("*", F.lit(None).cast("array<bigint>").alias("twos"), *(F.lit(None).cast("bigint").alias(r) for r in lines.RUNS))
    scratch = Scratch(spark, "test")
    cells = lines.shared_keys(scratch, unique)
    assert {tuple(r) for r in lines.first_pairs(scratch, cells, SIMILARITY).collect()} >= {(300 + i, i) for i in range(7)}
    assert cells.count() < 100, "rows of keys, of 307 nodes"


def test_rare_words_lose_no_pair(spark, monkeypatch):
    """In the second round keys that meet whole and keys that meet by rare words give all pairs that hold, of different components."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 11)))
    head = [word() for _ in range(20)]
    texts = [head + [word() for _ in range(20)] for _ in range(100)]
    for i in range(60):
        new = list(texts[i % 40])
        for j in rnd.sample(range(40), 3 + i % 8):
            new[j] = word()
        texts.append(new)
    docs = frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]).withColumn("key", F.col("doc_id"))
    scratch = Scratch(spark, "test")
    cells = lines.shared_keys(scratch, scratch.save(line_table(docs).withColumn("node", F.col("doc"))))
    norms = scratch.save(docs.select(F.col("doc_id").alias("node"), as_letters(codes_of(words_of(F.col("text")))).alias("norm")))
    comps = spark.createDataFrame([(i, 0) for i in (*range(20), *range(100, 120))], "node long, component long")
    held = lambda *more: {tuple(r) for r in lines.verified(scratch.save(lines.rest(scratch, cells, comps, SIMILARITY, *more)), norms, SIMILARITY).collect()}
    want, whole = held(), held(norms)
    monkeypatch.setattr(lines, "TILE", 50)
    assert len(want) > 20 and whole == want and held(norms) == want


def test_brute_force(spark):
    """Against all pairs of lines of a corpus of a small vocabulary, with copies in many versions: what goes is right, and what should go does to 0.9 at least."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 10))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    base = [rnd.choices(words, weights, k=rnd.randrange(5, 40)) for _ in range(60)]
    rows = []
    for i in range(260):
        line = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 1, 1, 2, len(line) // 5))):
            j = rnd.randrange(len(line))
            line[j : j + 1] = rnd.choice(([], [rnd.choice(words)], [line[j], rnd.choice(words)]))
        rows.append((i, " ".join(line)))
    norms = [norm(t).split() for _, t in rows]
    group = list(range(len(rows)))
    near = 0
    for i, a in enumerate(norms):
        for j in range(i):
            b = norms[j]
            if len(a) >= MIN_WORDS and len(b) >= MIN_WORDS and distance(a, b) <= (1 - SIMILARITY) * max(len(a), len(b)) + 1e-9:
                near += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    scratch = Scratch(spark, "test")
    gone = removed_lines(frame(spark, rows).withColumn("key", F.col("doc_id")), scratch)
    got = {r["key"] for r in gone.collect()}
    want = {i for i, g in enumerate(group) if g != i}
    assert near > 300 and got <= want and len(got) >= 0.97 * len(want), (len(got), len(want), near)


def test_short_lines(spark):
    rows = [(1, "All rights reserved\n \n\n1931\n你好，世界\n---"), (2, "all rights reserved.\n \n\n 1931\nnew\n你好，世界"), (3, "1932\n---\nAll rights\n\n1931 "), (4, None), (5, "")]
    got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in dedup_lines(frame(spark, rows), short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: (" \n\nnew", 3), 3: ("1932\nAll rights\n", 2), 4: (None, 0), 5: ("", 0)}
