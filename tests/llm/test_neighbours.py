import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours as N

KEYS = ["store", "generation_id", "dim"]
SCHEMA = "store string, generation_id string, dim int, document_id string, embedding array<float>, part int, cell int"


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(a, ids[j]), max(a, ids[j])) for j in order if s[i, j] >= least}
    return out


def pairs(spark, rows, **kw):
    df = spark.createDataFrame([("s", "g", d, i, e, 7, 7) for i, d, e in rows], SCHEMA)
    _, got = N.similar_pairs(df, KEYS, **kw)
    return {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got.collect()}


@pytest.fixture(scope="module")
def near():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((250, 16))
    out = {f"v{i:04d}": b.tolist() for i, b in enumerate(base)}
    for i in range(0, 250, 3):
        out[f"w{i:04d}"] = (base[i] * 3 + rng.standard_normal(16) * 0.25).tolist()
    return out


def test_pairs_match_brute_force_with_dirty_rows(spark, near):
    rows = [(i, 16, e) for i, e in near.items()]
    dirty = [("z1", 16, None), ("z2", 16, [0.0] * 16), ("z3", 16, [float("nan")] + [1.0] * 15), ("z4", 16, [1.0] * 8), ("z5", 0, []), (None, 16, [1.0] * 16)]
    assert pairs(spark, rows + dirty + rows[:20]) == brute(near, 10, 0.9)
    assert pairs(spark, dirty) == set()


def test_many_equal_vectors_use_the_smallest_ids(spark, near):
    hot = {f"h{i:03d}": [1.0] * 16 for i in range(150)}
    want = brute({**near, **hot}, 10, 0.9)
    assert pairs(spark, [(i, 16, e) for i, e in {**near, **hot}.items()]) == want


def test_tiles_give_the_same_pairs(spark, near, monkeypatch):
    monkeypatch.setattr(N, "TILE", 64)
    assert pairs(spark, [(i, 16, e) for i, e in near.items()]) == brute(near, 10, 0.9)


def test_recall_of_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32))
    df = spark.createDataFrame([("s", "g", 32, f"d{i:05d}", v.tolist(), 1, 1) for i, v in enumerate(x)], SCHEMA)
    _, got = N.nearest(df, KEYS, F.pmod(F.xxhash64("id"), F.lit(20)) == 0)
    found = {}
    for r in got.collect():
        found.setdefault(r["a"], set()).add(r["b"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    recall = []
    for a, bs in found.items():
        i = int(a[1:])
        s = u @ u[i]
        s[i] = -2
        recall.append(len(bs & {f"d{j:05d}" for j in np.argsort(-s)[:10]}) / 10)
    assert len(found) > 30 and np.mean(recall) >= 0.9


def test_anisotropic_codes_keep_parallel_error_small():
    rng = np.random.default_rng(2)
    x = N._unit(rng.standard_normal((800, 16)))
    pq = N.Quantiser.fit(x)
    codes = pq.encode(x)
    r = (N.Quantiser.padded(x) - np.take_along_axis(pq.books[None], codes[:, :, None, None].repeat(2, 3), 2)[:, :, 0]).reshape(len(x), -1)
    along = (r * x).sum(1)
    assert np.mean(along**2) < np.mean((r * r).sum(1)) / 16
    assert np.abs(pq.scores(x[:5], np.ascontiguousarray(pq.packed(x)[0].T)) - x[:5] @ x.T).max() < 0.35
