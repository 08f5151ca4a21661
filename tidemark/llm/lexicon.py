"""Operator 12: BPE encoding and decoding by a minimal acyclic transducer.

Texts split at white space into words, and no merge crosses one. All words are counted; the frequent ones are encoded once
and compiled into a minimal automaton that shares suffixes. Each edge carries a number, and the numbers along a word's path
add up to the word's place in a table of token ids, so suffixes are shared although every word has its own ids. The
automaton lies in a double array in one file that Spark sends to each executor, where the workers map it into memory, and
words walk through it side by side, a byte a step. Words that it does not know are merged exactly, by rank and then from
left to right, and remembered by content for a while. The lexicon only saves work; ids do not depend on it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.scratch import Scratch, deploy

#: Words in the lexicon, and bytes of the longest.
LEXICON_WORDS, LONGEST = 1 << 17, 32
#: Bytes of text worked on at once; distinct words that a worker counts, and unseen ones that it remembers, before it starts anew.
BLOCK, HELD = 1 << 20, 50_000
#: Rows that are decoded at once.
ROWS = 256
#: Code points beyond these go through the library's normaliser: below them no text changes under NFC, cases map one by
#: one, and str.split() cuts where the pattern for white space does.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\u02ff\\u2010-\\u2027\\u2030-\\u205e]")
#: Characters of lower-case words whose classes are known, and the runs that a word splits into; other words are split by the library.
_KNOWN = re.compile("[\\x00-\\x7f\\u00df-\\u00f6\\u00f8-\\u02af\\u2010-\\u2027\\u2030-\\u205e]*")
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\u00df-\\u02af]+|[0-9]|[^a-z\\u00df-\\u02af0-9]+")


#: Low bits of a rank that hold the id of the merged token; the rank of what never merges.
ID_BITS, NEVER = 24, 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in seen else next(other)) for b in range(256)]


class Merger:
    """Exact token ids of single words, from a tokenizer file whose BPE marks ends of words."""

    def __init__(self, path: str):
        import tokenizers

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        self.special = dict(special)
        self.split = re.compile("|".join(re.escape(t) for t, _ in sorted(special, key=lambda x: -len(x[0]))) or r"(?!)")
        self.rank = {}  # rank, then the new id in the low bits
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = i << ID_BITS | self.vocab[a + b]
        self.inner, self.last = ([self.vocab[c + end] for c in byte_symbols()] for end in ("", self.end))

    def normal(self, text: str) -> str:
        """The text in normal form, words with one space between."""
        if _PLAIN.search(text):
            return self.library.normalizer.normalize_str(text).strip(" ")
        return " ".join(text.lower().split())

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """(normal text, -1) and ("", id) for each part of a text between special tokens and each of these."""
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [(self.normal(text[at : m.start()]), -1), ("", self.special[m[0]])]
            at = m.end()
        out.append((self.normal(text[at:]) if at else self.normal(text), -1))
        return out

    def ids(self, word: str) -> list[int]:
        """Ids of a word without white space, cut into runs of letters, single digits and runs of other characters."""
        if _KNOWN.fullmatch(word):
            parts = [p.encode() for p in _RUNS.findall(word)]
            symbols = [[*map(self.inner.__getitem__, p[:-1]), self.last[p[-1]]] for p in parts]
        else:
            shown = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
            symbols = [[*map(self.vocab.__getitem__, p[:-1]), self.vocab[p[-1] + self.end]] for p in shown]
        return [i for x in symbols for i in (self.short(x) if len(x) < 40 else self.long(x))]

    def short(self, sym: list[int]) -> list[int]:
        """Merges by rank, of equal ranks the leftmost first."""
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(sym, sym[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            sym[i : i + 2] = [least & ((1 << ID_BITS) - 1)]
            del ranks[i]
            if i:
                ranks[i - 1] = get((sym[i - 1], sym[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((sym[i], sym[i + 1]), NEVER)
        return sym

    def long(self, sym: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs, and links between neighbours."""
        n, get, low = len(sym), self.rank.get, (1 << ID_BITS) - 1
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if sym[i] < 0 or j < 0 or get((sym[i], sym[j])) != rank:
                continue
            sym[i], sym[j], after[i] = rank & low, -1, after[j]
            if (nxt := after[i]) >= 0:
                before[nxt] = i
            for a, b in ((before[i], i), (i, nxt)):
                if a >= 0 and b >= 0 and (r := get((sym[a], sym[b]))) is not None:
                    heapq.heappush(queue, (r, a))
        return [s for s in sym if s >= 0]


def automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct words, as a double array whose edges number the words.

    Words are added in order; what no later word can change is replaced by an equal state at once (Daciuk's way), so no
    more states are ever held than the minimal ones and those of one word."""
    kids: list[dict[int, int]] = [{}]
    final, below, known, path = [False], [0], {}, []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            sign = final[child], tuple(kids[child].items())
            same = known.setdefault(sign, child)
            if same == child:
                below[child] = final[child] + sum(below[c] for c in kids[child].values())
            kids[parent][byte] = same

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            kids.append({})
            final.append(False)
            below.append(0)
            kids[state][byte] = len(kids) - 1
            path.append((state, byte, len(kids) - 1))
            state = len(kids) - 1
        final[state], last = True, word
    settle(0)
    live = [0, *sorted(set(known.values()))]
    number = {s: i for i, s in enumerate(live)}
    slots, used, free = [], bytearray(1 << 16), {}
    base = np.zeros(len(live), np.int32)
    for s in sorted(live, key=lambda s: -len(kids[s])):
        edges = list(kids[s].items())
        if not edges:
            continue
        at = used.find(0, free.get(len(edges), 256))
        while any(used[at - edges[0][0] + b] for b, _ in edges):
            at = used.find(0, at + 1)
        free[len(edges)] = at  # states with as many edges look on from here
        base[number[s]], count = at - edges[0][0], int(final[s])
        for b, c in edges:
            t = at - edges[0][0] + b
            used[t] = 1
            slots.append((t, number[s], number[c], count))
            count += below[c]
        if len(used) < at + 2048:
            used += bytearray(len(used))
    size = max([0, *(t for t, *_ in slots)]) + 257
    out = {"base": base, "final": np.array([final[s] for s in live], np.int32), "check": np.full(size, -1, np.int32), "target": np.zeros(size, np.int32), "out": np.zeros(size, np.int32)}
    if slots:
        t, parent, child, count = np.array(slots, np.int32).T
        out["check"][t], out["target"][t], out["out"][t] = parent, child, count
    return out


def compiled(words: list[str], merger: Merger) -> dict[str, np.ndarray]:
    """The automaton of the words and, by their numbers, their ids."""
    data = sorted({w.encode() for w in words})
    ids = [merger.ids(w.decode()) for w in data]
    off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return automaton(data) | {"off": off, "ids": np.array([i for x in ids for i in x], np.int32)}


NAMES = ["base", "final", "check", "target", "out", "off", "ids"]


def store(tables: dict[str, np.ndarray], path: Path) -> None:
    with path.open("wb") as f:
        f.write(np.array([len(tables[n]) for n in NAMES], np.int32).tobytes())
        for n in NAMES:
            f.write(tables[n].astype(np.int32).tobytes())


class Lexicon:
    """A stored automaton, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int32, "r")
        at = np.concatenate([[0], np.cumsum(whole[: len(NAMES)])]) + len(NAMES)
        for i, n in enumerate(NAMES):
            setattr(self, n, whole[at[i] : at[i + 1]])

    def find(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The numbers of the words raw[begin:stop], -1 for those that are not here."""
        found, live, at = np.full(len(begin), -1, np.int64), np.arange(len(begin)), begin
        state, rank = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        while len(live):
            ended = at >= stop[live]
            if ended.any():
                s = state[ended]
                found[live[ended]] = np.where(self.final[s] > 0, rank[ended], -1)
                on = ~ended
                live, at, state, rank = live[on], at[on], state[on], rank[on]
            edge = self.base[state] + raw[at]
            on = self.check[edge] == state
            edge = edge[on]
            live, at, state, rank = live[on], at[on] + 1, self.target[edge], rank[on] + self.out[edge]
        return found


_open: dict[str, object] = {}


def _held(kind, name: str):
    """What this worker has open for a file that Spark sent; the last one of each kind."""
    if _open.get(kind.__name__, (None,))[0] != name:
        _open[kind.__name__] = name, kind(SparkFiles.get(name))
    return _open[kind.__name__][1]


def _send(spark: SparkSession, path: Path) -> str:
    """Gives a file to each executor, once for each content; its name there."""
    name = f"{path.stem}-{hashlib.sha256(path.read_bytes()).hexdigest()[:24]}{path.suffix}"
    sent = getattr(spark.sparkContext, "_tidemark_files", set())
    if name not in sent:
        keep = Path(tempfile.mkdtemp(prefix="tidemark-send-")) / name
        keep.write_bytes(path.read_bytes())
        spark.sparkContext.addFile(str(keep))
        spark.sparkContext._tidemark_files = sent | {name}
    return name


def _parts(batches, merger: Merger):
    """(ids of rows, [(row, normal text, special)]) for runs of rows of about BLOCK bytes of text."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        off = k.texts_of(texts)[1]
        for lo, hi in k.chunks(off, BLOCK):
            yield keys.slice(lo, hi - lo), [(i, *p) for i, t in enumerate(texts.slice(lo, hi - lo).to_pylist()) for p in merger.pieces(t or "")]


def _counts(model: str):
    def run(batches):
        merger, seen = _held(Merger, model), Counter()

        def flush():
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for _, parts in _parts(batches, merger):
            for _, text, _ in parts:
                seen.update(w for w in text.split(" ") if len(w) <= LONGEST)
            if len(seen) > HELD:
                yield flush()
                seen.clear()
        yield flush()

    return run


def frequent_words(docs: DataFrame, model: str, most: int) -> list[str]:
    """About the `most` most frequent words of all texts, of at most LONGEST bytes, and never more.

    Counts fall into classes of one part in 64 of a doubling; whole classes are taken from the top while they fit, so the
    driver sees a row for each class and then the words themselves, however many tasks counted."""
    scratch = Scratch(docs.sparkSession, "words")
    counts = docs.mapInArrow(_counts(model), "word string, n bigint").where(f"octet_length(word) between 1 and {LONGEST}").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts.where("n > 1").withColumn("class", F.floor(F.log2("n") * 64)))
    taken, low = 0, None
    for r in counts.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
        if taken + r["n"] > most:
            break
        taken, low = taken + r["n"], r["class"]
    words = [] if low is None else [r["word"] for r in counts.where(F.col("class") >= low).select("word").collect()]
    scratch.drop(counts)
    return words


def _merged_words(words: list[bytes], merger: Merger, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of words that the lexicon does not have."""
    if len(memo) > HELD:
        memo.clear()
    out = []
    for w in words:
        ids = memo.get(w)
        if ids is None:
            ids = merger.ids(w.decode())
            if len(w) <= 1000:
                memo[w] = ids
        out.append(ids)
    return np.cumsum([0, *map(len, out)]), np.array([i for x in out for i in x], np.int32)


def _encoded(model: str, lexicon: str):
    def run(batches):
        merger, table, memo = _held(Merger, model), _held(Lexicon, lexicon), {}
        size = len(table.off) - 1
        for keys, parts in _parts(batches, merger):
            texts = [p[1].encode() for p in parts]
            data = b" ".join(texts)
            raw, part_bytes = np.frombuffer(data, np.uint8), np.array([len(t) for t in texts])
            first_byte = np.cumsum(part_bytes + 1) - part_bytes - 1
            space = raw == 32
            edge = np.flatnonzero(space)
            begin, stop = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(raw)]])
            some = stop > begin
            begin, stop = begin[some], stop[some]
            place = table.find(raw, begin, stop)
            part = np.searchsorted(first_byte, begin, "right") - 1
            special = np.array([p[2] for p in parts], np.int64)
            marks = np.flatnonzero(special >= 0)
            lost = np.flatnonzero(place < 0)
            words = [data[a:b] for a, b in zip(begin[lost].tolist(), stop[lost].tolist(), strict=True)]
            place[lost] = size + np.arange(len(lost))
            ext_off, ext_ids = _merged_words(words, merger, memo)
            tokens = np.sort(np.unique(special[marks]))
            where = np.searchsorted(part, marks)
            part = np.insert(part, where, marks)
            place = np.insert(place, where, size + len(words) + np.searchsorted(tokens, special[marks]))
            off = np.concatenate([table.off[:-1], table.off[-1] + ext_off[:-1], table.off[-1] + ext_off[-1] + np.arange(len(tokens) + 1)])
            ids = np.concatenate([table.ids, ext_ids, tokens.astype(np.int32)])
            n = off[place + 1] - off[place]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(off[place], n)
            flat = ids[at].astype("<u4")
            rows = np.array([p[0] for p in parts])[part]
            cut = np.concatenate([[0], np.cumsum(np.bincount(rows, n, len(keys)))]).astype(np.int64)
            yield pa.record_batch([keys, pa.array([flat[cut[i] : cut[i + 1]].tobytes() for i in range(len(keys))], pa.binary())], names=["doc_id", "ids"])

    return run


class Tokens(list):
    """The tokens of a tokenizer file by their ids."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        super().__init__([""] * (1 + max(ids.values())))
        for text, i in ids.items():
            self[i] = text


def _decoded(model: str):
    def run(batches):
        tokens = _held(Tokens, model)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                texts = [" ".join([tokens[i] for i in np.frombuffer(b or b"", "<u4").tolist()]) for b in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row of `docs`.

    `tokenizer` is a file of the tokenizers library, on the driver: BPE by words, with a suffix at the end of each and no
    decoder. Null and empty texts have no ids; ids of rows are carried as they are, null and repeated ones too. Other
    columns are not read. An empty table gives an empty result. A worker holds a few copies of its longest text."""
    spark = docs.sparkSession
    deploy(spark)
    model = _send(spark, Path(tokenizer))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with tempfile.TemporaryDirectory() as d:
        store(compiled(frequent_words(texts, model, words), Merger(tokenizer)), at := Path(d) / "lexicon.bin")
        lexicon = _send(spark, at)
    return texts.mapInArrow(_encoded(model, lexicon), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds `decoded`, the tokens with a space between, to doc_id and ids; special tokens stay."""
    spark = encoded.sparkSession
    deploy(spark)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(_send(spark, Path(tokenizer))), "doc_id bigint, ids binary, decoded string")


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
