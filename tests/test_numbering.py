import random

from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered


def test_numbers_in_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["n"] for r in numbered(df, [F.desc("a"), "b"], "n").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r: i for i, r in enumerate(want, 1)}


def test_one_key_and_nothing(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "a int, b int")
    assert sorted(r["n"] for r in numbered(df, ["a", "b"], "n").collect()) == list(range(1, 51))
    assert numbered(df.limit(0), ["a"], "n").count() == 0
