import numpy as np
import pytest

from tidemark.llm import embeddings
from tidemark.llm.embeddings import similar_vectors


def brute(rows, threshold=0.98):
    def good(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if good(v, label) else None for _, v, label in rows]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = [r[0] for r in rows]
    while True:
        new = [min([comp[i]] + [comp[j] for j in near[i]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted((r[0], len(near[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows))


def planted(seed=0, n=300, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    rows = [(i, base[i].tolist(), int(i % 3)) for i in range(n)]
    for j in range(200):  # around the threshold, and chains of them
        at = rows[rng.integers(len(rows))]
        noise = rng.standard_normal(dim) * np.linalg.norm(at[1]) / np.sqrt(dim) * rng.uniform(0.05, 0.25)
        rows.append((n + j, (np.array(at[1]) + noise).astype(np.float32).tolist(), at[2]))
    hot = rows[5]
    rows += [(2000 + j, hot[1], hot[2]) for j in range(150)]
    rows += [(3000 + j, (np.array(hot[1]) * 2 + rng.standard_normal(dim) * 0.05).astype(np.float32).tolist(), hot[2]) for j in range(120)]
    rows += [(4000, None, 1), (4001, [0.0] * dim, 1), (4002, [float("nan")] * dim, 1), (4003, hot[1], None), (4004, [], 1), (4005, [None] + hot[1][1:], 2), (4006, [float("inf")] + hot[1][1:], 2), (4007, hot[1][:8], hot[2])]
    return rows


@pytest.mark.parametrize("block", [512, 32])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted(tuple(r) for r in similar_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert similar_vectors(df).count() == 0


def test_repeated_ids(spark):
    """Rows of one id may hold different vectors; each keeps its own links."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [0.001, 1.0], 0), (3, [1.0, 0.001], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in similar_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows) and (3, 2, 1, False) in got
