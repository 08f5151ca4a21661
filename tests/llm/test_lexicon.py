import functools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import lexicon
from tidemark.llm.lexicon import Lexicon, Merger, automaton, compiled, decode, encode, store

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merger():
    return Merger(PATH)


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def library(text):
    t = tokenizer()
    ids = t.encode(text, add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def texts():
    rnd = random.Random(11)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEÉéßİıΣσςǅﬁÅ漢字かな한글ไทยहिन्दी😀👩‍👩‍👧0123456789٣²½'’.,;:!?-_<>|/\\\"\t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ​　﻿\x00"
    word = lambda: "".join(rnd.choice(chars) for _ in range(rnd.randrange(1, 12)))
    plain = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 10)))
    out = [" ".join(rnd.choice((word, plain))() for _ in range(rnd.randrange(0, 80))) for _ in range(150)]
    out += ["", " ", "\n\n", "'", "it's we'll THEY'RE I'd 'sS ''t", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|> <|endoftext|", "<|startoftext|><|endoftext|><|endoftext|>", " x <|endoftext|>\n", "é Å 가", "a" * 5000, "ab" * 3000 + " x", "é" * 2000, "x\x1cy\x1dz", "one\x85two\xa0three", "İ ΑΣ ΑΣ."]
    return out


def test_equals_the_library(spark):
    rows = list(enumerate(texts()))
    extra = [(None, "no id"), (5, "same id"), (-1, None), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, b"x", "y") for i, t in rows + extra], "doc_id long, text string, ids binary, decoded string").repartition(3)
    for words in (40, 5000):
        out = decode(encode(docs, PATH, words=words), PATH).collect()
        got = sorted((r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out)
        assert got == sorted((i or 0, *library(t or "")) for i, t in rows + extra)


def test_blocks_and_forgetting(spark, monkeypatch):
    rows = list(enumerate(texts()[:60]))
    m, d = Merger(PATH), {}
    monkeypatch.setattr(lexicon, "HELD", 3)
    for w in ("one", "two's", "three3", "one", "vier", "one"):
        off, ids = lexicon._merged_words([w.encode()], m, d)
        assert ids.tolist() == library(w)[0] and off.tolist() == [0, len(ids)]
    assert len(d) <= 4 and rows


def test_automaton_is_minimal_and_complete(tmp_path, merger):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(700)} | {"é", "éa", "walking", "talking", "walked", "talked"}
    store(compiled(list(words), merger), tmp_path / "l.bin")
    table = Lexicon(str(tmp_path / "l.bin"))
    asked = sorted(words) + ["", "d", "abcabcabc", "walk", "talkinga", "\xff"]
    raw = np.frombuffer("".join(asked).encode(), np.uint8)
    stop = np.cumsum([len(w.encode()) for w in asked])
    found = table.find(raw, stop - [len(w.encode()) for w in asked], stop)
    assert found[len(words) :].tolist() == [-1] * 6
    assert found[: len(words)].tolist() == [sorted(w.encode() for w in words).index(w.encode()) for w in sorted(words)]
    for w, i in zip(sorted(words), found, strict=False):
        assert table.ids[table.off[i] : table.off[i + 1]].tolist() == library(w)[0]
    ascii_words = sorted(w for w in words if w.isascii())
    endings: dict[str, set] = {}
    for w in ascii_words:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    assert len(automaton([w.encode() for w in ascii_words])["base"]) == len({frozenset(e) for e in endings.values()})


def test_both_ways_to_merge(merger):
    rnd = random.Random(9)
    for _ in range(400):
        word = [merger.inner[rnd.choice(b"etaoinshr")] for _ in range(rnd.randrange(1, 60))] + [merger.last[rnd.choice(b"aens")]]
        assert merger.short(list(word)) == merger.long(list(word))


def test_no_words(tmp_path, merger):
    store(compiled([], merger), tmp_path / "l.bin")
    assert Lexicon(str(tmp_path / "l.bin")).find(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


def test_empty(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0
