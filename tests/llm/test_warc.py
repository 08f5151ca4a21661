import gzip
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.scratch import Scratch
from tidemark.llm.warc import archive, loser_tree, url_key


def test_loser_tree():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rnd.randrange(9), i, j) for j in range(rnd.randrange(1, 20))) for i in range(k)]
        got = list(loser_tree(runs, lambda r: r[0]))
        assert [g[0] for g in got] == sorted(r[0] for run in runs for r in run)
        assert sorted(got) == sorted(r for run in runs for r in run)


def test_url_key():
    assert url_key("https://www.Blog.example.com:80/A?b=1#c") == "com,example,blog)/a?b=1"
    assert url_key("nothing") == "nothing" and url_key("//x.y") == "y,x)/"


def test_round_trip(spark):
    body = "x" * 99
    nasty = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n" * 5 + "é\x00"
    rows = [(1, "http://b.org/1", body), (2, "http://b.org/1", body), (5, "http://a.org/", body + "y"), (4, "http://a.org/\r\nX: y", body + "y"), (6, None, nasty), (7, "u", nasty), (8, "http://c.d/", None), (9, "http://c.d/", ""), (None, "http://n.n/", nasty)]
    rows += [(100 + i, "http://hot.org/", "hot" * 100) for i in range(300)] + [(500, "http://hot.org/", "z" * 300_000), (5, "http://a.org/", body + "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    out = archive(df).withColumn("part", F.spark_partition_id()).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            b = (html or "").encode()
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and i != first[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=key) == sorted(want, key=key)
    order = [(r["part"], r["urlkey"], r["date"]) for r in out]
    assert order == sorted(order) and [o[1] for o in order] == sorted(o[1] for o in order)


def test_offsets_and_ids(spark, tmp_path):
    """A record can be read by its offset and length alone; record ids are unique and references point to records."""
    rows = [(i % 40, f"http://h{i % 7}.org/{i}", f"page {i % 13} " * (i % 60)) for i in range(90)]
    path = str(tmp_path / "a")
    index = archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path).collect()
    ids, refs = set(), set()
    for r in index:
        data = (tmp_path / "a" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        head, http, payload = warc.parsed(zlib.decompress(data, 31))
        assert head["warc-target-uri"] == r["url"] and head["warc-type"] == r["record_type"] and int(http["content-length"]) == r["payload_bytes"]
        assert r["record_type"] == "revisit" or hashlib.sha256(payload).hexdigest() == r["payload_digest"]
        assert head["warc-record-id"] not in ids
        ids.add(head["warc-record-id"])
        refs.add(head.get("warc-refers-to", head["warc-record-id"]))
    assert len(ids) == len(index) == 90 and refs <= ids
    first = next((tmp_path / "a").glob("part-*"))
    assert gzip.decompress(first.read_bytes()).startswith(b"WARC/1.1")


def test_small_archives_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    rows = [(i, f"http://h{i % 3}.org/{i % 11}", "x" * 50) for i in range(300)]
    scratch = Scratch(spark, "t")
    path = f"{scratch.root}/a"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, scratch, run_bytes=1000)
    out = warc.read_index(spark, path, scratch).withColumn("part", F.spark_partition_id()).collect()
    order = [(r["urlkey"], r["date"], r["page_id"]) for r in out]
    assert len(out) == 300 and order == sorted(order) and len({r["part"] for r in out}) > 10


def test_dates_by_parameter(spark):
    """A column called date is read only if it is named; text that is no time counts as null."""
    df = spark.createDataFrame([(1, "http://a.b/", "x", "n/a"), (2, "http://a.b/", "y", "2020-05-06 07:08:09"), (3, "http://a.b/", "z", None)], "page_id long, url string, html string, date string")
    assert [r["date"][:4] for r in archive(df).collect()] == ["2023"] * 3
    got = {r["page_id"]: r["date"] for r in archive(df, date="date").collect()}
    assert got == {1: "1970-01-01T00:00:00Z", 2: "2020-05-06T07:08:09Z", 3: "1970-01-01T00:00:00Z"}


def test_empty(spark):
    assert archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.LEAST_BYTES == 100
