import hashlib

from tidemark.sources.provenance import chunk_digests, differences, file_digests, folder_digest


def make(path):
    (path / "a/b").mkdir(parents=True)
    (path / "a/b/big").write_bytes(bytes(range(256)) * 100)
    (path / "a/empty").write_bytes(b"")
    (path / "z é.txt").write_text("text")


def brute(path, chunk):
    lines = []
    for p in sorted((q for q in path.rglob("*") if q.is_file()), key=lambda q: str(q.relative_to(path)).encode()):
        data = p.read_bytes()
        parts = [hashlib.sha256(data[i : i + chunk]).hexdigest() for i in range(0, max(1, len(data)), chunk)]
        lines.append(f"{hashlib.sha256(''.join(parts).encode()).hexdigest()}\t{len(data)}\t{p.relative_to(path)}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_digests_and_changes(spark, tmp_path):
    make(tmp_path)
    before = spark.createDataFrame(chunk_digests(spark, str(tmp_path), chunk=1000).collect())
    assert before.where("file = 'a/b/big'").count() == 26 and before.count() == 28
    one = folder_digest(file_digests(before)).first()
    assert tuple(one) == (3, 25604, brute(tmp_path, 1000))
    assert folder_digest(file_digests(before.repartition(7))).first() == one
    assert differences(before, chunk_digests(spark, str(tmp_path), chunk=1000)).isEmpty()
    data = bytearray((tmp_path / "a/b/big").read_bytes())
    data[7500] ^= 1
    (tmp_path / "a/b/big").write_bytes(data)
    (tmp_path / "new").write_text("n")
    (tmp_path / "a/empty").unlink()
    after = chunk_digests(spark, str(tmp_path), chunk=1000)
    assert sorted(tuple(r) for r in differences(before, after).collect()) == [("a/b/big", "changed", 7, 1), ("a/empty", "removed", 0, 1), ("new", "added", 0, 1)]
    assert folder_digest(file_digests(after)).first()["digest"] != one["digest"]


def test_empty_folder(spark, tmp_path):
    chunks = chunk_digests(spark, str(tmp_path))
    assert tuple(folder_digest(file_digests(chunks)).first()) == (0, 0, hashlib.sha256(b"").hexdigest())
