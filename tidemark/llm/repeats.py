"""Exact removal of token windows that repeat, for bytes (op 2) and words (op 8).

Three exchanges, each of packed, compressed arrays rather than of rows:

1. Anchors. Each window of `width` tokens holds at least one winnowed anchor, the `gram`-token string of least
   hash in it, chosen by the window's content alone. Only windows whose anchor repeats can repeat. The same
   exchange finds rows that are exact copies of others, so that one of a group stands for all.
2. Windows. Every window with a repeated anchor is hashed; hashes meet by range of the hash, are sorted there and
   neighbours are compared. The hash space is dealt with in `slices`, one after the other, to bound the disk.
3. Spans. Marked windows return to their rows, where they merge into maximal intervals.

Before each exchange a task keeps one entry for each hash that it holds more than once, so a passage of a third of
all rows sends a few entries a task, whatever its count. Window hashes are polynomials modulo 2**61 - 1 at a random
point, so of n windows of w tokens two different ones are taken for equal with probability w * n * n / 2**62 at most,
and about n * n / 2**62 for ordinary text; whole texts and rows have xxh3 hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.kernels import U
from tidemark.llm.scratch import Scratch, partitions

PACKED = "part int, kind int, blob binary"
ANCHOR, FLAG, TEXT = 0, 1, 2
COPY, CHIEF = -1, -2
NULL_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Spec:
    unit: str  # "byte" or "word"
    width: int
    gram: int
    #: "any": a window counts that starts at two places; "smaller": one that also starts in a row of smaller id
    rule: str
    parts: int
    slices: int
    keep_text: bool
    chunk: int

    @property
    def result(self) -> str:
        return "doc_id bigint, n_tokens bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<bigint>, kept string" * self.keep_text


def _tokens(spec: Spec, raw: np.ndarray, off: np.ndarray):
    if spec.unit == "byte":
        return k.BYTE[raw], off
    tok, _, _, first = k.word_tokens(raw, off)
    return tok, first


def _grams(spec: Spec, tok: np.ndarray, first: np.ndarray):
    """Prefix sums, gram hashes, and for each token the least gram hash of the window that starts there."""
    p, n = k.prefix(tok), len(tok)
    h = np.full(n, k.TOP)
    if n >= spec.gram:
        whole = k.window_starts(first, spec.gram)[: n - spec.gram + 1]
        g = k.rolling(p, spec.gram)
        h[: len(g)] = np.where(whole, g, k.TOP)
    least = k.sliding(h, spec.width - spec.gram + 1, True)
    return p, h, least


def _record(parts: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def _send(spec: Spec, kind: int, part: np.ndarray, keys: list[int], **arrays):
    for p, rows in k.by_part(part, spec.parts):
        yield _record([keys[p]], [kind], [k.dump(**{name: x[rows] for name, x in arrays.items()})])


def _flags(spec: Spec, keys: list[int], key: np.ndarray, pos: np.ndarray):
    if len(key):
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        yield from _send(spec, FLAG, (key % U(spec.parts)).astype(np.int64), keys, key=key, pos=pos.astype(np.int32))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: where each run begins, and the run of each value."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _judge(rule: str, windows: bool, h, key, doc, pos, multi):
    """(order, marked, sent): of entries in `order`, which are known to repeat, and which still stand for their hash.

    Copy entries (pos -1) always go by the smallest (doc, key). Anchor entries only tell whether a hash repeats at
    all ("any") or in two ids ("smaller"); window entries whether it starts elsewhere, or in a smaller id."""
    order = np.argsort(h)
    h, key, doc, pos, multi = h[order], key[order], doc[order], pos[order], multi[order]
    begin, run = _runs(h)
    if not len(begin):
        return order, np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
    low = np.minimum.reduceat(doc, begin)
    many = np.logical_or.reduceat(multi, begin)
    if rule == "any":
        repeat = many | (np.diff(np.append(begin, len(h))) >= 2)
    else:
        repeat = many | (np.maximum.reduceat(doc, begin) != low)
    if windows and rule == "smaller":
        marked, sent = doc > low[run], doc == low[run]
    else:
        marked, sent = repeat[run], np.zeros(len(h), bool)
        sent[begin] = True
    if not windows:
        copies, first = pos == COPY, doc == low[run]
        chief = first & (key == np.minimum.reduceat(np.where(first, key, k.TOP), begin)[run])
        marked = np.where(copies, ~chief if rule == "any" else ~first, marked)
        sent = np.where(copies, chief, sent)
    return order, marked, sent, repeat[run]


def _local(spec: Spec, keys: list[int], windows: bool, h, key, doc, pos):
    """What a task sends of its own entries: flags that are certain already, and one stand-in for each hash."""
    if not len(h):
        return
    order, marked, sent, repeat = _judge(spec.rule, windows, h, key, doc, pos, np.zeros(len(h), bool))
    h, key, doc, pos = h[order], key[order], doc[order], pos[order]
    if windows and spec.rule == "smaller":
        multi = np.zeros(len(h), bool)
    else:
        multi = repeat
    yield from _flags(spec, keys, key[marked], pos[marked])
    s = np.flatnonzero(sent)
    s = s[np.lexsort((pos[s], key[s]))]
    part = ((h[s] >> U(32)) % U(spec.parts)).astype(np.int64)
    yield from _send(spec, ANCHOR, part, keys, h=h[s], key=key[s], doc=doc[s], pos=pos[s].astype(np.int32), multi=multi[s])


def _gather(spec: Spec, windows: bool):
    def run(batches):
        keys, found = k.route_keys(spec.parts), []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == ANCHOR:
                    found.append(k.load(blob.as_py()))
                else:
                    key = k.load(blob.as_py())["key"]
                    yield _record([keys[int(key[0] % U(spec.parts))]], [FLAG], [blob.as_py()])
        if not found:
            return
        h, key, doc, pos, multi = (np.concatenate([x[name] for x in found]) for name in ("h", "key", "doc", "pos", "multi"))
        del found
        order, marked, _, repeat = _judge(spec.rule, windows, h, key, doc, pos, multi)
        key, pos = key[order], pos[order]
        if spec.rule == "any":
            chief = repeat & (pos == COPY) & ~marked
            pos = np.where(chief, CHIEF, pos)
            marked = marked | chief
        yield from _flags(spec, keys, key[marked], pos[marked])

    return run


def _rows(batch):
    """Ids (null as the largest), whether null, bytes and offsets of a batch."""
    ids = batch.column(0)
    null = np.asarray(ids.is_null())
    doc = np.where(null, NULL_ID, np.asarray(ids.fill_null(0)).astype(np.int64))
    return doc, null, *k.texts_of(batch.column(1))


def _digests(raw: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's text, and of its id and text."""
    text = k.digests(raw, off)[:, 0]
    return text, k.mix(text ^ k.mix(doc.astype(U)))


def _scan(spec: Spec):
    def run(batches):
        keys = k.route_keys(spec.parts)
        for batch in batches:
            doc, _, raw, off = _rows(batch)
            out: list[tuple] = []
            for lo, hi in k.chunks(off, spec.chunk):
                r, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                text, key = _digests(r, o, doc[lo:hi])
                tok, first = _tokens(spec, r, o)
                _, h, least = _grams(spec, tok, first)
                row = k.spans(first, len(tok))
                top = np.where(k.window_starts(first, spec.width), least, U(0))
                top = k.sliding(top[::-1], spec.width - spec.gram + 1, False)[::-1]
                at = np.flatnonzero((top == h) & (h != k.TOP))
                out.append((h[at], key[row[at]], doc[lo:hi][row[at]], at - first[row[at]]))
                long = np.flatnonzero(np.diff(first) >= spec.width)
                out.append((k.mix(text[long] ^ U(0x5DEECE66D)), key[long], doc[lo:hi][long], np.full(len(long), COPY)))
            if out:
                yield from _local(spec, keys, False, *(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _ship(spec: Spec):
    """Texts, packed by the hash of id and text."""

    def run(batches):
        keys = k.route_keys(spec.parts)
        for batch in batches:
            doc, null, raw, off = _rows(batch)
            key = np.concatenate([np.zeros(0, U), *(_digests(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], doc[lo:hi])[1] for lo, hi in k.chunks(off, spec.chunk))])
            for p, rows in k.by_part((key % U(spec.parts)).astype(np.int64), spec.parts):
                yield _record([keys[p]], [TEXT], [_pack(doc[rows], null[rows], key[rows], [raw[off[i] : off[i + 1]] for i in rows])])

    return run


def _pack(doc, null, key, pieces, **more) -> bytes:
    off = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(x) for x in pieces], out=off[1:])
    return k.dump(doc=doc, null=null, key=key, raw=np.concatenate([np.zeros(0, np.uint8), *pieces]), off=off, **more)


def _sorted_in(batches):
    """All flags of a partition sorted by key, and its texts, still packed."""
    flags, texts = [], []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            (flags if kind == FLAG else texts).append(blob.as_py())
    key, pos = np.zeros(0, U), np.zeros(0, np.int32)
    if flags:
        got = [k.load(x) for x in flags]
        key, pos = np.concatenate([x["key"] for x in got]), np.concatenate([x["pos"] for x in got])
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
    return key, pos, texts


def _hits(fkey, fpos, key):
    """(row, position) of the flags of these rows."""
    lo, hi = np.searchsorted(fkey, key, "left"), np.searchsorted(fkey, key, "right")
    n = hi - lo
    row = np.repeat(np.arange(len(key)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return row, fpos[at].astype(np.int64)


def _marks(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    out[at] = True
    return out


def _candidates(spec: Spec):
    """From texts and anchor flags: results of rows that are settled, and a packed rest with its candidate windows."""

    def run(batches):
        fkey, fpos, texts = _sorted_in(batches)
        keys = k.route_keys(spec.parts)
        for blob in texts:
            x = k.load(blob)
            for lo, hi in k.chunks(x["off"], spec.chunk):
                off = x["off"][lo : hi + 1] - x["off"][lo]
                raw, doc, null, key = x["raw"][x["off"][lo] : x["off"][hi]], x["doc"][lo:hi], x["null"][lo:hi], x["key"][lo:hi]
                row, pos = _hits(fkey, fpos, key)
                chief, copy = _marks(len(key), row[pos == CHIEF]), _marks(len(key), row[pos == COPY])
                tok, first = _tokens(spec, raw, off)
                cand = np.zeros(len(tok), bool)
                if (pos >= 0).any():
                    _, h, least = _grams(spec, tok, first)
                    hit = pos >= 0
                    tag = lambda value, r: k.mix(value ^ k.mix(r.astype(U) + U(1)))
                    wanted = tag(h[first[row[hit]] + pos[hit]], row[hit])
                    touched = np.repeat(_marks(len(key), row[hit]), np.diff(first))
                    s = np.flatnonzero(k.window_starts(first, spec.width) & touched)
                    cand[s] = np.isin(tag(least[s], k.spans(first, len(tok))[s]), wanted)
                drop = copy & ~chief
                has = np.zeros(len(key), bool)
                has[np.unique(k.spans(first, len(tok))[cand])] = True
                rest = np.flatnonzero((has & ~drop) | chief)
                done = np.flatnonzero(~((has & ~drop) | chief))
                removed = np.repeat(drop, np.diff(first))
                if len(done):
                    yield _wrap(spec, _finish(spec, doc, null, raw, off, first, removed, done))
                if len(rest):
                    pieces = [raw[off[i] : off[i + 1]] for i in rest]
                    bits = np.packbits(np.concatenate([cand[first[i] : first[i + 1]] for i in rest]))
                    for p, mine in [(int(key[rest[0]] % U(spec.parts)), rest)]:
                        yield _wrap(spec, None, keys[p], _pack(doc[mine], null[mine], key[mine], pieces, cand=bits, chief=chief[mine]))

    return run


def _finish(spec: Spec, doc, null, raw, off, first, removed, rows) -> pa.RecordBatch:
    """Result rows: what is left of each text, and its removed runs."""
    n = np.diff(first)[rows]
    edge = np.zeros(len(removed) + 1, bool)
    edge[first] = True
    prev = np.zeros(len(removed), bool)
    prev[1:] = removed[:-1]
    begins = removed & (~prev | edge[:-1])
    gone, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, begins))
    data = raw.tobytes()
    sha, kept, cuts = [], [], []
    for i in rows:
        a, b = first[i], first[i + 1]
        text = data[off[i] : off[i + 1]]
        mask = removed[a:b]
        some = bool(gone[b] - gone[a])
        if spec.unit == "byte":
            left = raw[off[i] : off[i + 1]][~mask].tobytes() if some else text
        else:
            words = text.split()
            left = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if some else words)
        sha.append(hashlib.sha256(left).hexdigest())
        if spec.keep_text:
            kept.append(left.decode("utf-8", "replace"))
            d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            cuts.append(np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], 1).ravel().tolist())
    columns = [pa.array(doc[rows], pa.int64(), mask=null[rows]), pa.array(n.astype(np.int64)), pa.array(gone[first[rows + 1]] - gone[first[rows]], pa.int64()), pa.array(runs[first[rows + 1]] - runs[first[rows]], pa.int64()), pa.array(sha, pa.string())]
    names = ["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256"]
    if spec.keep_text:
        columns += [pa.array(cuts, pa.list_(pa.int64())), pa.array(kept, pa.string())]
        names += ["spans", "kept"]
    return pa.record_batch(columns, names=names)


def _wrap(spec: Spec, done: pa.RecordBatch | None, part: int = 0, blob: bytes | None = None) -> pa.RecordBatch:
    """Settled rows or one packed blob, in one schema."""
    if done is None:
        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"spans": pa.list_(pa.int64()), "kept": pa.string()} if spec.keep_text else {})
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([TEXT], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, t) for t in types.values())], names=["part", "kind", "blob", *types])
    n = done.num_rows
    return pa.record_batch([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *done.columns], names=["part", "kind", "blob", *done.schema.names])


def _windows(spec: Spec, turn: int):
    """Hashes of the candidate windows of one slice of the hash space."""

    def run(batches):
        keys, out, held = k.route_keys(spec.parts), [], 0
        for batch in batches:
            for blob in batch.column(2):
                x = k.load(blob.as_py())
                tok, first = _tokens(spec, x["raw"], x["off"])
                at = np.flatnonzero(np.unpackbits(x["cand"], count=len(tok)))
                h = k.hashed(k.prefix(tok), at, at + spec.width)
                mine = np.flatnonzero((h >> U(16)) % U(spec.slices) == U(turn)) if spec.slices > 1 else np.arange(len(h))
                row = k.spans(first, len(tok))[at[mine]]
                out.append((h[mine], x["key"][row], x["doc"][row], at[mine] - first[row]))
                held += len(mine)
                if held >= 1_000_000:
                    yield from _local(spec, keys, True, *(np.concatenate(c) for c in zip(*out, strict=True)))
                    out, held = [], 0
        if out:
            yield from _local(spec, keys, True, *(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


def _apply(spec: Spec):
    def run(batches):
        fkey, fpos, texts = _sorted_in(batches)
        for blob in texts:
            x = k.load(blob)
            tok, first = _tokens(spec, x["raw"], x["off"])
            row, pos = _hits(fkey, fpos, x["key"])
            edge = np.zeros(len(tok) + 1, np.int64)
            at = first[row] + pos
            np.add.at(edge, at, 1)
            np.add.at(edge, at + spec.width, -1)
            removed = np.cumsum(edge[:-1]) > 0
            removed |= np.repeat(x["chief"], np.diff(first))
            yield _finish(spec, x["doc"], x["null"], x["raw"], x["off"], first, removed, np.arange(len(x["doc"])))

    return run


def remove_repeats(docs: DataFrame, unit: str, width: int, rule: str, *, gram: int | None = None, slices: int = 1, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, n_removed, n_spans, kept_sha256 and, with keep_text, spans
    (start, stop, start, stop, ... in tokens) and kept.

    Null texts are empty; null ids count as the largest. Rows of one id and text each get a result. Other columns are
    not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    spec = Spec(unit, width, gram or width // 2, rule, partitions(spark), slices, keep_text, 1 << 20 if unit == "byte" else 2 << 20)
    scratch = Scratch(spark, f"repeats-{unit}")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    deal = lambda df: df.repartition(spec.parts, "part")
    flags = scratch.save(deal(texts.mapInArrow(_scan(spec), PACKED)).mapInArrow(_gather(spec, False), PACKED))
    first = scratch.save(deal(texts.mapInArrow(_ship(spec), PACKED).unionByName(flags)).mapInArrow(_candidates(spec), f"{PACKED}, {spec.result}"))
    scratch.drop(flags)
    rest = first.where(F.col("blob").isNotNull()).select("part", "kind", "blob")
    marks = [scratch.save(deal(rest.mapInArrow(_windows(spec, turn), PACKED)).mapInArrow(_gather(spec, True), PACKED)) for turn in range(spec.slices)]
    both = rest
    for m in marks:
        both = both.unionByName(m)
    settled = first.where(F.col("blob").isNull()).drop("part", "kind", "blob")
    return settled.unionByName(deal(both).mapInArrow(_apply(spec), spec.result))
