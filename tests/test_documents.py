import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources.documents import join_parts, write_collection


def features(spark, n):
    return spark.range(n).select((F.col("id") * 7919 % max(1, n)).alias("k"), F.format_string('{"type": "Feature", "properties": {"k": %d, "t": "é\\\\n"}}', F.col("id") * 7919 % max(1, n)).alias("feature")).repartition(5)


@pytest.mark.parametrize(("n", "parts"), [(1000, 7), (3, 8), (0, 3)])
def test_one_document_in_order(spark, tmp_path, n, parts):
    for _ in range(2):  # the second one takes the first one's place
        write_collection(features(spark, n), str(tmp_path / "c"), ["k"], parts=parts)
    join_parts(str(tmp_path / "c"), str(tmp_path / "one.json"))
    got = json.loads((tmp_path / "one.json").read_text())
    assert got["type"] == "FeatureCollection" and [f["properties"]["k"] for f in got["features"]] == list(range(n))
    assert len(list((tmp_path / "c").glob("*-b.json"))) > (4 if n == 1000 else -1)
    assert not list((tmp_path / "c").glob(".work*"))


def test_not_whole(spark, tmp_path):
    (tmp_path / "00000000-a.json").write_text("{")
    with pytest.raises(ValueError, match="no whole document"):
        join_parts(str(tmp_path), str(tmp_path / "one"))


def test_a_failing_task_leaves_the_old_document(spark, tmp_path):
    write_collection(features(spark, 10), str(tmp_path / "c"), ["k"], parts=2)
    bad = features(spark, 10).withColumn("feature", F.when(F.col("k") == 5, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="broken"):
        write_collection(bad, str(tmp_path / "c"), ["k"], parts=2)
    join_parts(str(tmp_path / "c"), str(tmp_path / "one"))
    assert len(json.loads((tmp_path / "one").read_text())["features"]) == 10
