import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations as c
from tidemark.llm.collocations import collocations


def brute(rows, longest=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + s]) for s in range(1, longest + 1) for i in range(len(w) - s + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        inside = [b for (m, *v), b in cand.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= cover * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def planted(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 4))) for _ in range(40)]
    sep = lambda: rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ", "-", "\x00 ", "\x1c", "\xa0"])
    text = lambda n: "".join(rnd.choice(words) + sep() for _ in range(n))
    rows = [(i, rnd.choice(["en", "de", None, "", "und"]), text(rnd.randrange(0, 120))) for i in range(120)]
    rows += [(200 + i, "en", "New York City " * 3 + text(5)) for i in range(20)]
    rows += [(300 + i, "en", "the same text, again and again") for i in range(50)]
    rows += [(400, "de", None), (401, "de", ""), (402, None, "ab " * 500), (403, "fr", "x" * 5000), (None, "en", text(60)), (7, "en", rows[7][2]), (404, "de", text(4000)), (405, "xx", "one"), (406, "es", "a b. " * 11)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, t, "p", 1) for i, x, t in rows], "doc_id long, lang string, text string, phrase string, h int").repartition(5)


@pytest.mark.parametrize("shards", [1, 3, 9])
def test_equals_brute_force(spark, shards):
    rows = planted(shards)
    assert sorted(tuple(r) for r in collocations(frame(spark, rows), shards=shards).collect()) == brute(rows)


def test_longer_phrases_and_other_limits(spark):
    rows = planted(4)
    got = collocations(frame(spark, rows), longest=4, least=4, top=7, cover=80, shards=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 4, 7, 80)


def test_parts_of_texts_and_tails():
    """Counting after every few words, with texts in small parts, loses and doubles nothing."""
    import pyarrow as pa

    rows = planted(6)
    batch = pa.record_batch([pa.array([x or "und" for _, x, _ in rows]), pa.array([(t or "").encode() for _, _, t in rows])], names=["lang", "text"])

    def counts():
        seen = Counter()
        for words, langs, levels in c._counts([batch], 3):
            for lang, ids, _, _, count in levels:
                for x, w, m in zip(lang, ids, count, strict=True):
                    seen[langs[x], *(words[i] for i in w)] += int(m)
        return +seen

    whole = counts()
    with pytest.MonkeyPatch.context() as m:
        for block, part in ((1, 1), (7, 30), (50, 11)):
            m.setattr(c, "BLOCK", block)
            m.setattr(c, "TEXT_BLOCK", part)
            assert counts() == whole


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "_bitmap", lambda hashes: b"\xff" * (c.BITS // 8))
    rows = planted(5)
    assert sorted(tuple(r) for r in collocations(frame(spark, rows)).collect()) == brute(rows)


def test_large_numbers(spark, monkeypatch):
    counts = [("en", 0, "", 3 * 10**13), ("en", 1, "a", 10**13), ("en", 1, "b", 10**13 - 1), ("en", 2, "a b", 9 * 10**12 + 7)]
    monkeypatch.setattr(c, "phrase_counts", lambda *a, **b: spark.createDataFrame(counts, "lang string, size int, phrase string, c bigint"))
    a = 9 * 10**12 + 7
    assert [tuple(r) for r in collocations(spark.range(1)).collect()] == [("en", 1, "a b", a, 10**13, 10**13 - 1, 3 * 10**13, 10**6 * a * a // (10**13 * (10**13 - 1)))]


def test_empty(spark):
    assert collocations(frame(spark, planted()).limit(0)).count() == 0
