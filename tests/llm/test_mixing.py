import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.mixing import DIMS, FLATTEN, mix


def reference(cells):
    """Raking and scale in NumPy; cells: {(source, lang, topic): tokens}."""
    keys, w0 = list(cells), np.array(list(cells.values()), float)
    codes = [np.unique([repr(k[d]) for k in keys], return_inverse=True)[1] for d in range(3)]
    total, w = w0.sum(), w0.copy()
    targets = []
    for d in range(3):
        m = np.bincount(codes[d], w0) ** FLATTEN[DIMS[d]]
        targets.append(m / m.sum() * total)
    for _ in range(200):
        for d in range(3):
            w *= (targets[d] / np.bincount(codes[d], w))[codes[d]]
    f, lo, hi = w / w0, 1e-9, 1e9
    for _ in range(200):
        c = (lo * hi) ** 0.5
        lo, hi = (c, hi) if (np.minimum(1, c * f) * w0).sum() < mixing.KEEP * total else (lo, c)
    return dict(zip(keys, np.minimum(1, hi * f), strict=True))


def test_equals_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        s = "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}"
        text = " ".join(["w"] * int(rng.integers(0, 300))) + rng.choice(["", " a@b ", " | ", "Licensed under"])
        rows.append((i, text, str(rng.choice(["en", "de"])) if rng.random() > 0.05 else None, s, 1.0, "x"))
    rows += [(5000, None, "en", None, 1.0, "x"), (5001, "", "en", "hot", 1.0, "x"), (5001, "", "en", "hot", 1.0, "x"), (None, "a b", "de", "hot", 1.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability double, topic string")
    out = mix(df).select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "probability", "kept").collect()
    assert len(out) == len(rows)
    cells = {}
    for r in out:
        key = (r["source"], r["lang"], r["topic"])
        cells[key] = cells.get(key, 0) + r["n_tokens"]
    want = reference(cells)
    assert all(abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 1e-5 for r in out)
    share = sum(r["n_tokens"] for r in out if r["kept"]) / sum(r["n_tokens"] for r in out)
    assert abs(share - mixing.KEEP) < 0.06


def test_shuffled_cells_agree(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 1500, "hot").otherwise("s").alias("source"))
    one = sorted(map(tuple, mix(df).select("row.doc_id", "probability", "kept").collect()))
    monkeypatch.setattr(mixing, "SMALL_TABLE", 0)
    assert sorted(map(tuple, mix(df).select("row.doc_id", "probability", "kept").collect())) == one


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_given_targets(spark):
    """Marginals reach the shares that the caller gives; a value without a share goes."""
    rng = np.random.default_rng(1)
    rows = [(None if i % 10 == 0 else i, f"{i} " + "w " * int(rng.integers(5, 50)), str(rng.choice(["en", "de"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), str(rng.choice(["x", "y"]))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    out = mix(df, keep=0.1, targets={"source": {"a": 1, "b": 1, "c": 0}, "lang": {"en": 0.5, "de": 0.5}}, topic=F.col("kind"))
    got = out.select("row.source", "row.lang", "topic", F.col("n_tokens").alias("n"), "probability", "kept").toPandas()
    assert set(got["topic"]) == {"x", "y"} and not got[got["source"] == "c"]["kept"].any()
    for d, share in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"en": 0.5, "de": 0.5})):
        mass = (got["n"] * got["probability"]).groupby(got[d]).sum()
        for v, x in share.items():
            assert abs(mass[v] / mass.sum() - x) < 1e-3
    kept = got[got["kept"]]
    assert abs(kept["n"].sum() / got["n"].sum() - 0.1) < 0.02 and 0 < kept.shape[0] < 1200
