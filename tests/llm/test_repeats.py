import collections
import hashlib
import random
import re

import pytest

from tidemark.llm.byte_repeats import dedup_bytes
from tidemark.llm.word_repeats import dedup_windows


def brute_bytes(rows, w):
    seen, data = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + w] for s in range(len(b) - w + 1))
    out = []
    for i, b in data:
        m = bytearray(len(b))
        for s in range(len(b) - w + 1):
            if seen[b[s : s + w]] > 1:
                m[s : s + w] = b"\1" * w
        left = bytes(x for x, gone in zip(b, m, strict=True) if not gone)
        out.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(left).hexdigest()))
    return out


def brute_words(rows, w):
    low, data = {}, [(i, (t or "").encode().split()) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, x in data:
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            low[k] = min(low.get(k, rank(i)), rank(i))
    out = []
    for i, x in data:
        m = bytearray(len(x))
        for s in range(len(x) - w + 1):
            if low[tuple(x[s : s + w])] < rank(i):
                m[s : s + w] = b"\1" * w
        out.append((i, len(x), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(b" ".join(a for a, gone in zip(x, m, strict=True) if not gone)).hexdigest()))
    return out


def planted(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    text = lambda n: rnd.choice([" ", "\n", "  ", "\t"]).join(rnd.choice(words) for _ in range(n))
    shared = [text(rnd.randrange(8, 60)) for _ in range(6)]
    rows = [(i, " ".join(rnd.sample([text(rnd.randrange(0, 40)), rnd.choice(shared), text(rnd.randrange(0, 40)), rnd.choice(shared)], 4))) for i in range(60)]
    rows += [(100 + i, " ".join(w if rnd.random() > 0.05 else rnd.choice(words) for w in rows[3][1].split(" "))) for i in range(25)]  # near copies
    rows += [(200 + i, rows[5][1]) for i in range(40)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a" * 3000), (304, "a" * 50), (305, "ab " * 800), (7, rows[7][1]), (306, "x"), (306, "x"), (None, rows[9][1]), (None, shared[0]), (307, text(3000))]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n_tokens int").repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("width", [20, 60])
@pytest.mark.parametrize("slices", [1, 3])
def test_bytes(spark, width, slices):
    rows = planted(width)
    out = dedup_bytes(frame(spark, rows), width, slices=slices).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == ordered(brute_bytes(rows, width))
    for r in out:
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)) == r["n_removed"]


@pytest.mark.parametrize("width", [5, 12])
def test_words(spark, width):
    rows = planted(width)
    out = dedup_windows(frame(spark, rows), width).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == ordered(brute_words(rows, width))


def test_many_partitions_and_chunks(spark, monkeypatch):
    rows = planted(1)
    monkeypatch.setattr("tidemark.llm.repeats.partitions", lambda s: 11)
    out = dedup_windows(frame(spark, rows).repartition(7), 8, keep_text=False).collect()
    assert ordered(tuple(r) for r in out) == ordered(brute_words(rows, 8))


def test_empty(spark):
    d = frame(spark, planted(1)).limit(0)
    assert dedup_bytes(d).count() == 0 and dedup_windows(d).count() == 0


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_texts_that_defeat_power_of_two_moduli(spark):
    """Texts of two tokens by a Thue-Morse pattern and its complement collide in any polynomial hash modulo 2**64."""
    t = thue_morse(1024)
    texts = ["".join(("xa", "xb")[b ^ flip] for b in t[:512]) for flip in (0, 1)] + ["".join(f"{'ab'[b ^ flip]}{'cd'[i % 2]}" for i, b in enumerate(t)) for flip in (0, 1)]
    rows = list(enumerate(texts))
    out = dedup_bytes(frame(spark, rows)).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == ordered(brute_bytes(rows, 200))
    t = thue_morse(4096)
    rows = [(flip, " ".join(f"{'ab'[b ^ flip]}" if i % 2 else f"w{i}" for i, b in enumerate(t))) for flip in (0, 1)] + [(2 + flip, " ".join(f"{'ab'[b ^ flip]}" for b in t)) for flip in (0, 1)]
    out = dedup_windows(frame(spark, rows)).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == ordered(brute_words(rows, 50))
