import random

import numpy as np
import pytest

from tidemark.llm.quality import best_cut, calibrated, resample, top_threshold


def corpus(seed=0, n=1500):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda: " ".join(rnd.choice(words[: rnd.choice((50, 500, 3000))]) for _ in range(rnd.randrange(30, 300)))
    docs, labels = [], []
    for i in range(n):
        t, kind = text(), rnd.random()
        if kind < 0.1:
            w = t.split()
            for _ in range(max(2, len(w) // 25)):
                w[rnd.randrange(len(w))] = rnd.choice(("scumword", "idiotword", "trashword"))
            t = " ".join(w)
        elif kind < 0.2:
            t = " ".join(w + "!!" for w in t.split())
        docs.append((i, t))
        if i % 2:
            labels.append((i, 0 if 0.1 <= kind < 0.2 else 1, 1 if kind < 0.1 else 0))
    truth = {i: not ("scumword" in t or "idiotword" in t or "trashword" in t or "!!" in t) for i, t in docs}
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    docs += [(9000, None), (9001, ""), (3, docs[3][1]), (None, docs[5][1])]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, weight double")
    out = resample(d, spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 9000 and r["doc_id"] % 2 == 0]
    good, bad = [r for r in held if truth[r["doc_id"]]], [r for r in held if not truth[r["doc_id"]]]
    assert np.mean([r["kept"] for r in good]) > 0.97 and np.mean([r["kept"] for r in bad]) < 0.1


def test_no_labels_keep_all(spark):
    docs, _, _ = corpus(n=40)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(d, none).where("kept").count() == 40 and resample(d.limit(0), none).count() == 0


def test_threshold(spark):
    rng = np.random.default_rng(0)
    for keys in (rng.standard_normal(5000), np.repeat([1.0, 2.0, 3.0], 100), np.array([5.0]), np.concatenate([rng.standard_normal(100), [1e9, -1e9]])):
        df = spark.createDataFrame([(float(x),) for x in keys], "key double")
        for k in {1, len(keys) // 3 + 1, len(keys)}:
            t, m = top_threshold(df, k)
            assert t == np.sort(keys)[::-1][k - 1] and m == k - (keys > t).sum()


@pytest.mark.parametrize("w, g, lo, hi", [([0, 1, 2, 3], [0, 0, 1, 1], 1, 2), ([0, 1], [1, 1], -np.inf, 0), ([0, 1], [0, 0], 1, np.inf)])
def test_cut(w, g, lo, hi):
    c = best_cut(np.array(w, float), np.array(g, bool))
    assert lo <= c <= hi


def test_resampling_follows_the_weights(spark):
    """Brute force: Gumbel keys of scale one over the weights, and the k largest stay; null ids draw by their texts."""
    docs, labels, _ = corpus(n=600)
    docs = [(None if i % 7 == 0 else i, t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 7], "doc_id long, quality int, toxic int")
    for k in (1, 100, 600):
        out = resample(d, lab, k=k).toPandas()
        noise = out["key"] - out["weight"]
        assert len(set(noise.round(9))) == len(out) and abs(noise.mean() - 0.5772) < 0.2 and abs(noise.std() - 1.2825) < 0.2
        assert out["kept"].sum() == k and out[out["kept"]]["key"].min() >= out[~out["kept"]]["key"].max() if k < 600 else out["kept"].all()
    assert resample(d, lab, k=0).where("kept").count() == 0


def test_calibration():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(20_000) * 3
    good = rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * x - 1)))
    a, b = calibrated(x, good)
    assert abs(a - 0.7) < 0.05 and abs(b + 1) < 0.1
    a, b = calibrated(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True]))
    assert np.isfinite([a, b]).all() and a > 0 and 1 < -b / a < 2
