import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import minhash
from tidemark.llm.graph import components, lookup
from tidemark.llm.kernels import route_keys
from tidemark.llm.minhash import linked, near_duplicates
from tidemark.llm.scratch import Scratch

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, size=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def planted():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.randrange(1, 90))) for i in range(80)]
    for j in range(60):
        w = rnd.choice(rows)[1].split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((100 + j, " ".join(w).upper()))
    hot = text(120).split()
    for j in range(150):  # a group of near copies, some of them only linked through others
        w = list(hot)
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((300 + j, " ".join(w)))
    rows += [(600 + j, " \n".join(hot)) for j in range(40)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "x" * 100_000)]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, g int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(d).collect()}
    assert got == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = planted()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(d).collect()} == {k: v[1] for k, v in brute(rows).items()}


def test_null_ids_and_repeats(spark):
    t = "a b c d e f g h"
    d = spark.createDataFrame([(None, t), (None, t), (3, t), (3, t), (1, t)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(d).collect())
    assert got == {(None, None, True): 2, (3, 1, False): 2, (1, 1, True): 1}
    assert near_duplicates(d.limit(0)).count() == 0


def test_linked_joins_all_that_links():
    rng = np.random.default_rng(0)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(100, 140, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(40)]
    comp = np.arange(40)
    label = np.arange(40)
    for i, j in linked(sets, comp, 75):
        label[label == label[j]] = label[i]
    want = np.arange(40)
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want[want == want[j]] = want[i]
    assert len(set(label)) == len(set(want))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 50)] + [(rnd.randrange(300, 340), rnd.randrange(300, 340)) for _ in range(60)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_lookup_with_hot_key(spark):
    left = spark.createDataFrame([(0, i) for i in range(3000)] + [(k, k) for k in range(1, 50)], "k long, x long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "k * 2 as y", "n")
    out = lookup(left, right, ["k"], "n")
    assert out.count() == 3049 and out.where("y <> k * 2").count() == 0


def test_route_keys(spark):
    for n in (3, 12, 49):
        d = spark.createDataFrame([(k,) for k in route_keys(n)], "k int").repartition(n, "k")
        parts = d.selectExpr("k", "spark_partition_id() as p").collect()
        assert {r["k"]: r["p"] for r in parts} == {k: i for i, k in enumerate(route_keys(n))}


def test_texts_that_defeat_power_of_two_moduli(spark):
    pattern = [bin(i).count("1") % 2 for i in range(4096)]
    rows = [(flip, " ".join("ab"[b ^ flip] + (f"{i}" if i % 2 else "") for i, b in enumerate(pattern))) for flip in (0, 1)]
    rows += [(2 + flip, " ".join("ab"[b ^ flip] for b in pattern)) for flip in (0, 1)] + [(5, "  " + rows[0][1].replace(" ", "\n ").upper() + "\t")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(d).collect()}
    assert got == brute(rows) and got[0][1] != got[1][1] and got[5][1] == 0
