import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import middle
from tidemark.llm.middle import Memo, Outline, candidates, cuts, fill_in_middle, restored


def brute(i, text):
    t = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[j : j + 8], 16) for j in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(w), "plain", None, None, t
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def planted():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcXYZé漢😀-<>SPM' ") for _ in range(rnd.randrange(1, 9))) for _ in range(500)]
    text = lambda n: rnd.choice([" ", "\n", "", ". "]).join(rnd.choice(words) for _ in range(n))
    shared = text(900)
    rows = [(i, text(rnd.randrange(0, 700))) for i in range(120)]
    rows += [(200 + i, text(rnd.randrange(0, 90)) + shared + text(rnd.randrange(0, 90))) for i in range(40)]
    rows += [(300 + i, shared) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "a" * 50_000), (403, "é" * 30_000), (404, "0" * 30_000), (405, "has <P> in it"), (406, "<S"), (407, "<"), (408, "x<M>"), (-5, shared), (None, shared), (7, rows[7][1]), (409, "\x00\r\n\t"), (410, text(60_000))]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "k", 3, b"x") for i, t in rows], "doc_id long, text string, output string, n int, form binary").repartition(3)
    out = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert sorted((r["doc_id"] or 0, r["back"]) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_every_cut(monkeypatch):
    """Each unit of texts whose chunks are tiny is found, runs of letters across several chunks included."""
    for name, value in (("LEAST", 3), ("MEAN", 4), ("MOST", 9), ("BLOCK", 50)):
        monkeypatch.setattr(middle, name, value)
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice(["ab", "é", "漢", " ", "Q" * 30, "😀", "1"]) for _ in range(rnd.randrange(1, 60)))
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        o = Outline(data, cuts(raw, candidates(raw), 0, len(data)), 0, Memo(40))
        w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert o.units[-1] == len(w) and max(b - a for a, b in zip(o.edges, o.edges[1:], strict=False)) <= 9
        for u in range(len(w) + 1):
            before = "".join(w[:u])
            assert o.place(u) == (len(before.encode()), len(before))


def test_shared_chunks_are_counted_once():
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdefgh .,") for _ in range(60_000))
    memo = Memo()
    for lead in ("", "x", "some other words before "):
        data = (lead + shared).encode()
        raw = np.frombuffer(data, np.uint8)
        Outline(data, cuts(raw, candidates(raw), 0, len(data)), 0, memo)
    assert memo.hits > 1.7 * len(memo.known) and len(memo.known) > 20


def test_blocks_make_no_difference(monkeypatch):
    raw = np.frombuffer(np.random.default_rng(3).bytes(20_000), np.uint8)
    whole = candidates(raw).tolist()
    monkeypatch.setattr(middle, "BLOCK", 777)
    assert candidates(raw).tolist() == whole


def test_empty(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
