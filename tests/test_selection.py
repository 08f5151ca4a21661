import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import robust, selection


def values():
    rnd = random.Random(2)
    out = [("flat", 3.25)] * 900
    out += [("wide", rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300)) for _ in range(3001)]
    out += [("near", 1.0 + rnd.randrange(2000) * 2.0**-52) for _ in range(2000)]
    out += [("tiny", rnd.choice([0.0, -0.0, 5e-324, -5e-324, 1e-310])) for _ in range(1500)]
    out += [("two", 1.0)] * 700 + [("two", 2.0)] * 700
    out += [("norm", rnd.gauss(10, 2)) for _ in range(4000)] + [("one", 7.0), ("pair", 1.0), ("pair", 4.0)]
    out += [(None, float(i)) for i in range(1000)] + [("norm", None), ("norm", float("nan")), ("norm", float("inf")), ("none", None)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("hot", "few"), [(0, 1), (0, 50), (1200, 10), (10**9, 10)])
def test_equal_to_percentile(spark, hot, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.createDataFrame(values(), "k string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {r["k"]: tuple(r)[1:] for r in selection.quantiles(df, ["k"], "v", qs, hot_rows=hot).collect()}
    rows = df.where(~F.isnan("v") & (F.abs("v") < float("inf")))
    want = {r["k"]: tuple(r)[1:] for r in rows.groupBy("k").agg(*(F.percentile("v", q).alias(n) for n, q in qs.items())).collect()}
    assert got == want and None in got and "none" not in got


def test_more_rounds_with_few_bins(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 3)
    monkeypatch.setattr(selection, "FEW", 400)
    df = spark.createDataFrame([(i * 37 % 5000 / 7.0,) for i in range(5000)], "v double")
    got = selection.quantiles(df, [], "v", {"m": 0.5, "p": 0.33}, hot_rows=0).first()
    assert tuple(got) == tuple(df.agg(F.percentile("v", 0.5), F.percentile("v", 0.33)).first())


def test_robust_stats(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 100)
    df = spark.createDataFrame([r for r in values() if r[0] != "wide"], "k string, v double").withColumn("y", F.lit(1))
    plain = {r["k"]: r.asDict() for r in robust.robust_stats(df, ["k"], "v").collect()}
    got = {r["k"]: r.asDict() for r in selection.robust_stats_any(df, ["k"], "v", hot_rows=500).collect()}
    assert got.keys() == plain.keys()
    for k, r in got.items():
        for c in r.keys() - {"k"}:
            assert r[c] == (None if plain[k][c] is None else pytest.approx(plain[k][c], rel=1e-12, abs=1e-12)), (k, c)
    total = selection.robust_stats_with_total(df, ["y"], "k", "v", hot_rows=500).where("is_total").collect()
    (want,) = robust.robust_stats(df, ["y"], "v").collect()
    assert len(total) == 1 and all(total[0][c] == pytest.approx(want[c], rel=1e-12) for c in ("n_points", "median", "mad", "p05", "p95", "mean", "std"))


def test_no_group_is_gathered(spark):
    """Of a group of 200,000 values no task gets more rows than bins: the plan of a round has no exchange of single values."""
    df = spark.range(200_000).select((F.xxhash64("id") / 2.0**40).alias("v"))
    got = selection.quantiles(df, [], "v", {"m": 0.5}, hot_rows=1000).first()["m"]
    assert got == df.agg(F.percentile("v", 0.5)).first()[0]


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert selection.quantiles(df, ["k"], "v", {"m": 0.5}, hot_rows=0).count() == 0
    assert selection.robust_stats_any(df, ["k"], "v").count() == 0


def test_quantiles_with_total(spark):
    rows = [(y, float((i * 7919 + y) % 10007)) for y in (1995, 1996, 1997) for i in range(9000 if y == 1995 else 300)] + [(None, 5.0), (None, 7.0), (1998, None), (1998, float("nan"))]
    df = spark.createDataFrame(rows, "y int, v double").repartition(5)
    got = {(r["y"], r["is_total"]): r for r in selection.quantiles_with_total(df, [], "y", "v", {"m": 0.5, "p05": 0.05, "p95": 0.95}, hot_rows=1000).collect()}
    assert len(got) == 6
    for k in [("1995", False), ("1996", False), ("1997", False), (None, False), ("ALL", True)]:
        x = [v for y, v in rows if v is not None and v == v and (k[1] or (y is None) == (k[0] is None) and str(y) in (k[0], "None"))]
        r = got[k]
        assert [r["m"], r["p05"], r["p95"]] == pytest.approx([np.percentile(x, q) for q in (50, 5, 95)], abs=1e-9), k
    assert got["ALL", True]["n"] == len(rows) and got["1998", False]["n"] == 2 and got["1998", False]["m"] is None
