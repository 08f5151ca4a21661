import datetime
import random

import pytest

from tidemark.operators.search import search

T0 = datetime.datetime(2020, 1, 1)
SCHEMA = "id string, west double, south double, east double, north double, start timestamp, end timestamp"


def rows(n, seed, name):
    rnd, out = random.Random(seed), []
    for i in range(n):
        w, s = rnd.uniform(-180, 180), rnd.uniform(-90, 90)
        size, days = rnd.choice([0.0, 0.1, 3.0, 60.0]), rnd.choice([0.0, 0.02, 5.0, 800.0])
        e = w + size
        a = T0 + datetime.timedelta(days=rnd.uniform(0, 900))
        out.append((f"{name}{i}", w, s, e - 360 if e > 180 else e, min(90.0, s + size), a, a + datetime.timedelta(days=days)))
    return out


def extra(name):
    t = T0
    return [(f"{name}A", -180.0, -90.0, 180.0, 90.0, t, t + datetime.timedelta(days=4000)), (f"{name}B", 179.0, 0.0, -179.0, 1.0, t, t), (f"{name}C", 178.0, 0.5, -178.0, 0.7, t, t), (f"{name}D", 10.0, 10.0, 10.0, 10.0, t, t), (f"{name}E", None, 1.0, 2.0, 3.0, t, t), (f"{name}F", 1.0, 1.0, float("nan"), 3.0, t, t), (f"{name}G", 1.0, 1.0, 2.0, 3.0, t, t - datetime.timedelta(1)), (f"{name}H", 1.0, 1.0, 2.0, 3.0, None, t), (f"{name}I", 0.5, 0.5, 1.0, 1.0, t, t), (f"{name}J", 1.0, 1.0, 1.5, 1.5, t, t)]


def whole(r):
    return all(x is not None and x == x for x in r[1:]) and r[2] <= r[4] and r[5] <= r[6]


def parts(r):
    return [(r[1], r[3])] if r[1] <= r[3] else [(r[1], 180.0), (-180.0, r[3])]


def meets(a, b):
    over = any(w <= f and v <= e for w, e in parts(a) for v, f in parts(b))
    return over and a[2] <= b[4] and b[2] <= a[4] and a[5] <= b[6] and b[5] <= a[6]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    left, right = rows(250, seed, "g") + extra("g"), rows(120, seed + 10, "q") + extra("q")
    got = sorted((r["granule"]["id"], r["area"]["id"]) for r in search(spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA)).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if whole(a) and whole(b) and meets(a, b))
    assert got == want and len(got) > 300


def test_repeated_rows_and_nothing(spark):
    one = spark.createDataFrame(extra("g")[3:4] * 2, SCHEMA)
    assert search(one, one).count() == 4
    assert search(one.limit(0), one).count() == 0 and search(one, one.limit(0)).count() == 0
