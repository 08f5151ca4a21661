"""Operator 3: WARC archives with revisit records, and a merged capture index.

A task sorts its captures by URL key and time and packs each record as a gzip member of its own, so an index entry's
offset and length are enough to read it. Archives are bounded blocks of bytes that Spark's text writer writes, so any
file system that Spark reaches will do. Reading parses the members one by one. Each archive's captures are a sorted run;
the index is range-partitioned by URL key, time and page into ranges of bounded size, and in each range the pieces of
the runs meet in a k-way merge by a loser tree.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import lookup
from tidemark.llm.scratch import Scratch, partitions

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
EOL, GAP = "\r\n", "\r\n\r\n"
#: Stands behind each archive; readers of gzip take zero bytes for padding.
PAD = "\0"
#: Bytes of records in an archive, about, and index entries in a range of the merge, about.
RUN_BYTES, RANGE_ROWS = 32 << 20, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, date string, page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, file string, offset bigint, length bigint"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]


def url_key(url: str) -> str:
    """Host labels in reverse, then the path and query, in lower case: one site's captures lie together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I)
    if not m:
        return url.lower()
    return f"{','.join(reversed(m[1].lower().removeprefix('www.').split('.')))}){m[2].lower() or '/'}"


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page of smaller id has."""
    many = pages.where(f"bytes >= {LEAST_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = lookup(pages.where(f"bytes >= {LEAST_BYTES}").select("page_id", "digest"), scratch.save(many), ["digest"], "n")
    return again.where("page_id is null or page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def _id(page, digest: str, nth: int) -> str:
    """A record's id; rows of one page and payload are told apart by their number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {nth}')}>"


def _record(kind: str, head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), *head, ("Content-Length", str(len(block)))]
    text = "WARC/1.1" + EOL + "".join(f"{name}: {value}{EOL}" for name, value in lines) + EOL
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + GAP.encode()) + pack.flush()


def _pack(run_bytes: int):
    """Archives of about `run_bytes` of records from the sorted rows of a partition."""

    def run(batches):
        seen: dict[tuple, int] = {}
        out, size = [], 0
        for batch in batches:
            for page, url, html, date, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out:
                    out.append(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'info {page} {digest} {len(seen)}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], f"format: WARC File Format 1.1{EOL}".encode()))
                nth = seen[page, digest] = seen.get((page, digest), -1) + 1
                payload = html.encode()
                http = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{GAP}".encode()
                head = [("WARC-Record-ID", _id(page, digest, nth)), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"\s+", "%20", url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page is None else str(page))]
                if refers_to is not None:
                    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to, digest, 0)), ("X-Refers-To-Page-ID", str(refers_to))]
                head.append(("Content-Type", "application/http; msgtype=response"))
                out.append(_record("response" if refers_to is None else "revisit", head, http + (payload if refers_to is None else b"")))
                size += len(payload)
                if size >= run_bytes:
                    yield pa.record_batch([pa.array([b"".join(out)])], names=["archive"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array([b"".join(out)])], names=["archive"])

    return run


def write_archives(pages: DataFrame, path: str, scratch: Scratch, *, date: str | None = None, run_bytes: int = RUN_BYTES) -> None:
    """Writes archives of about `run_bytes` of records; `pages` has page_id, url and html.

    `date` names the column with the times of capture, a timestamp, date or text (one that is no time counts as null);
    without it times follow from page_id, and other columns, one called date too, are not read. Null html is an empty
    payload, null url an empty one, a null date the epoch. A null page_id is written without number
    and never referred to."""
    text = F.coalesce("html", F.lit(""))
    key = F.col("page_id").cast("bigint")
    when = F.col(date).try_cast("timestamp") if date else F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce(key, F.lit(0)), F.lit(100_000_000)))
    rows = pages.select(key.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), text.alias("html"), when.alias("date"))
    rows = rows.withColumns({"bytes": F.octet_length("html"), "digest": F.sha2("html", 256)})
    narrow = scratch.save(rows.select("page_id", "digest", "bytes"))
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    marks = revisits(narrow, scratch)
    n = int(max(partitions(pages.sparkSession), total // run_bytes + 1))
    both = F.xxhash64("page_id", "digest").alias("both")
    rows = rows.select("*", both).repartition(n, "both").join(marks.select(both, "refers_to"), "both", "left")  # payloads move once
    host = F.reverse(F.split(F.lower(F.regexp_extract("url", r"//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)), r"\."))
    run = rows.withColumn("host", F.array_join(host, ",")).sortWithinPartitions("host", F.lower("url"), "date", "page_id")
    run = run.select("page_id", "url", "html", F.coalesce(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("date"), "digest", "refers_to")
    run.mapInArrow(_pack(run_bytes), "archive binary").select(F.col("archive").cast("string").alias("value")).write.option("lineSep", PAD).text(path)


def members(data) -> Iterator[tuple[bytes, int, int]]:
    """Content, offset and length of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        unpack, start, out = zlib.decompressobj(31), at, []
        while not unpack.eof:
            part = view[at : at + (1 << 16)]
            if not len(part):
                raise ValueError(f"the member at {start} ends early")
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out), start, at - start


def parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a record, by the length that its headers give."""
    top, _, rest = record.partition(b"\r\n\r\n")
    lines = top.decode().split(EOL)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = lambda part: {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in part)}
    head = fields(lines[1:])
    block = rest[: int(head["content-length"])]
    if head["warc-type"] == "warcinfo":
        return head, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, fields(http.decode().split(EOL)[1:]), payload


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _read(batches):
    """The captures of each archive, sorted."""
    for batch in batches:
        for i in range(batch.num_rows):
            file, out = batch.column(0)[i].as_py().rsplit("/", 1)[-1], []
            for record, at, size in members(batch.column(1)[i].as_buffer()):
                head, http, payload = parsed(record)
                if head["warc-type"] == "warcinfo":
                    continue
                digest, n = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                if head["warc-type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file}: the record at {at} is damaged")
                url = head.get("warc-target-uri", "")
                out.append((url_key(url), head["warc-date"], _number(head["x-page-id"]), url, head["warc-type"], digest, n, _number(head.get("x-refers-to-page-id")), file, at, size))
            out.sort(key=_order)
            for lo in range(0, len(out), 10_000):
                yield _index(out[lo : lo + 10_000])


def _index(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def loser_tree(runs: list[list[tuple]], key) -> Iterator[tuple]:
    """Merges sorted runs; each step replays one path of the tree, log2(runs) comparisons."""
    k = len(runs)
    if not k:
        return
    heads: list[tuple | None] = [(key(r[0]), i) for i, r in enumerate(runs)]
    at, tree = [0] * k, [-1] * k

    def beats(a: int, b: int) -> bool:
        return heads[b] is None or (heads[a] is not None and heads[a] < heads[b])

    def settle(i: int) -> int:
        """The winner of the subtree of node i; losers stay in their nodes."""
        if i >= k:
            return i - k
        a, b = settle(2 * i), settle(2 * i + 1)
        winner, tree[i] = (a, b) if beats(a, b) else (b, a)
        return winner

    best = settle(1) if k > 1 else 0
    while heads[best] is not None:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = (key(runs[best][at[best]]), best) if at[best] < len(runs[best]) else None
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                best, tree[node] = tree[node], best
            node //= 2


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _merge(batches):
    """One range in order: the pieces of its runs, each of one archive, merged."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[8], []).append(row)
    for run in runs.values():
        run.sort(key=_order)  # one pass where Spark hands a piece on in its order
    out = []
    for row in loser_tree(list(runs.values()), _order):
        out.append(row)
        if len(out) >= 10_000:
            yield _index(out)
            out = []
    if out:
        yield _index(out)


def read_index(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The capture history of all archives under `path`, globally ordered by URL key, time and page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    lines = scratch.save(files.mapInArrow(_read, INDEX))
    ranges = max(partitions(spark), lines.count() // RANGE_ROWS + 1)
    return lines.repartitionByRange(ranges, "urlkey", "date", "page_id", "file", "offset").mapInArrow(_merge, INDEX)


def archive(pages: DataFrame, path: str | None = None, *, date: str | None = None) -> DataFrame:
    """Writes `pages` to archives (under the shared folder if no path is given) and returns their merged index.

    Of pages with equal payloads of at least LEAST_BYTES bytes the one of smallest id is a response, the others are
    revisits. `date` names the column of capture times. Repeated rows each get a record. An empty table gives an empty
    index; other columns are not read."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = path or f"{scratch.root}/archives"
    write_archives(pages, path, scratch, date=date)
    return read_index(pages.sparkSession, path, scratch)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "date")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1),
u AS (SELECT p.*, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)', ['host', 'rest']) AS m FROM p)
SELECT u.page_id, CAST(u.n AS BIGINT) AS payload_bytes, u.d AS payload_digest,
       CASE WHEN f.first IS NULL OR u.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN u.page_id <> f.first THEN f.first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(lower(m.host), '^www\.', ''), '.')), ',') || ')' ||
         CASE WHEN m.rest = '' THEN '/' ELSE lower(m.rest) END AS urlkey,
       strftime(make_timestamp((1700000000 + u.page_id % 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date
FROM u LEFT JOIN f ON f.d = u.d AND u.n >= 100
"""
