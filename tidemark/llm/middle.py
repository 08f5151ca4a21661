"""Operator 13: fill-in-the-middle by content-defined chunks.

A Gear rolling hash over the last 32 bytes cuts each text into chunks of about a kilobyte, at places that depend on the
bytes around them only, so copies and shared passages fall into the same chunks wherever they lie. A chunk's boundary
summary (units, code points, whether it begins and ends inside a run of letters) is computed once and kept by its
content: the memo compares the chunk's bytes, so two different chunks never share a summary. Summaries combine from left
to right, where a run of letters that goes on across a boundary counts once; their running sums tell which chunk holds
the n-th unit, and only that chunk is scanned for the place. No step shuffles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as k
from tidemark.llm.scratch import deploy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: Bytes that the rolling hash sees; least, mean (a power of two) and largest bytes of a chunk.
WINDOW, LEAST, MEAN, MOST = 32, 128, 1024, 8192
#: Bytes hashed at once, and bytes of chunks that a worker's memo holds before it starts anew.
BLOCK, MEMO_BYTES = 1 << 22, 32 << 20
GEAR = np.random.default_rng(20250301).integers(0, 1 << 32, 256, dtype=np.uint32)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[b] << age over the last WINDOW bytes, built by doubling."""
    h, have = GEAR[raw], 1
    while have < WINDOW:
        older = h[:-have] << np.uint32(have)
        h = h.copy()
        h[have:] += older
        have *= 2
    return h


def candidates(raw: np.ndarray) -> np.ndarray:
    """Places where a chunk may begin: the hash of the bytes before has its top bits clear, and a code point begins."""
    found = []
    for lo in range(0, len(raw), BLOCK):
        a = max(0, lo - WINDOW)
        h = gear(raw[a : lo + BLOCK])[lo - a :]
        found.append(np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + lo + 1)
    at = np.concatenate([np.zeros(0, np.int64), *found])
    at = at[at < len(raw)]
    return at[LEAD[raw[at]]]


def cuts(raw: np.ndarray, may: np.ndarray, lo: int, hi: int) -> list[int]:
    """Chunk edges of the text raw[lo:hi], from lo to hi. The first WINDOW bytes, whose hash sees other texts, have none."""
    edges, at, n = [lo], lo, len(may)
    while True:
        i = int(np.searchsorted(may, at + LEAST))
        to = int(may[i]) if i < n else hi
        if min(to, hi) - at > MOST:
            to = at + MOST
            while not LEAD[raw[to]]:
                to -= 1
        if to >= hi:
            break
        edges.append(to)
        at = to
    edges.append(hi)
    return edges


def starts(piece: np.ndarray) -> np.ndarray:
    """Mask of the bytes of a chunk at which a unit `[A-Za-z]+|[^A-Za-z]` begins."""
    letter = LETTER[piece]
    out = LEAD[piece]
    out[1:] &= ~(letter[1:] & letter[:-1])
    return out


class Memo:
    """Boundary summaries by the chunks' content."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.known, self.hits = most, 0, {}, 0

    def summary(self, piece: bytes) -> tuple[int, int, bool, bool]:
        """(units, code points, begins with a letter, ends with one); a dict compares the bytes of equal hashes."""
        got = self.known.get(piece)
        if got is not None:
            self.hits += 1
            return got
        x = np.frombuffer(piece, np.uint8)
        got = int(np.count_nonzero(starts(x))), int(np.count_nonzero(LEAD[x])), bool(LETTER[x[0]]), bool(LETTER[x[-1]])
        if self.held + len(piece) > self.most:
            self.known, self.held = {}, 0
        self.known[piece] = got
        self.held += len(piece)
        return got


class Outline:
    """The combined summaries of one text's chunks."""

    def __init__(self, data: bytes, edges: list[int], base: int, memo: Memo):
        self.data = data
        self.edges = [e - base for e in edges]
        self.units, self.points, self.joined = [0], [0], []
        ends = False
        if len(data):
            for a, b in zip(self.edges, self.edges[1:], strict=False):
                n, c, first, last = memo.summary(data[a:b])
                self.joined.append(ends and first)
                self.units.append(self.units[-1] + n - (ends and first))
                self.points.append(self.points[-1] + c)
                ends = last

    def place(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the given unit, or before the end."""
        if unit >= self.units[-1]:
            return len(self.data), self.points[-1]
        j = int(np.searchsorted(self.units, unit, "right")) - 1
        a, b = self.edges[j], self.edges[j + 1]
        x = np.frombuffer(self.data[a:b], np.uint8)
        at = int(np.flatnonzero(starts(x))[unit - self.units[j] + self.joined[j]])
        return a + at, self.points[j] + int(np.count_nonzero(LEAD[x[:at]]))


def draws(doc_id: int | None, salt: str) -> list[int]:
    """The first four groups of eight hex digits of the digest of salt and id."""
    d = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i : i + 4], "big") for i in range(0, 16, 4)]


def _turned(salt: str, plain_from: int, spm_below: int):
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        memo = Memo()
        for batch in batches:
            raw, off = k.texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in k.chunks(off, BLOCK):
                part, edge = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                may, rows = candidates(part), []
                for i in range(hi - lo):
                    a, b = int(edge[i]), int(edge[i + 1])
                    data = part[a:b].tobytes()
                    text = Outline(data, cuts(part, may, a, b), a, memo)
                    n, h = text.units[-1], draws(ids[lo + i], salt)
                    if not data or any(x in data for x in marks) or h[2] % 100 >= plain_from:
                        rows.append((ids[lo + i], n, "plain", None, None, data))
                        continue
                    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    (ab, ac), (bb, bc) = text.place(x), text.place(y)
                    form = "spm" if h[3] % 100 < spm_below else "psm"
                    order = (s, data[bb:], p, data[:ab], m, data[ab:bb]) if form == "spm" else (p, data[:ab], s, data[bb:], m, data[ab:bb])
                    rows.append((ids[lo + i], n, form, ac, bc - ac, b"".join(order)))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, *, salt: str = "1", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: one row for each row of `docs`.

    Null texts are empty and plain; a null id draws from the salt alone; rows of one id draw alike, and each gets its
    row. Other columns are not read, so their names may be anything. An empty table gives an empty result. A worker holds
    a few copies of its longest text, and hashes it in blocks."""
    deploy(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_turned(salt, plain_from, spm_below), RESULT)


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form. No text that was cut holds a marker, so each marker occurs once."""
    first, second = (F.split_part(output, F.lit(a), F.lit(2)) for a in (PREFIX, SUFFIX))
    until = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(until(first, SUFFIX), middle, until(second, MIDDLE))
    spm = F.concat(until(first, MIDDLE), middle, until(second, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
