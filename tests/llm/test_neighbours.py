"""Neighbours against brute force: recall, exact scores and order, odd vectors."""

import numpy as np
import pytest

from skyfuse.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string, leaf int"


def run(spark, vectors, **kw):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in vectors]
    return neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()


def brute(vectors, every, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([np.array(v, np.float32) for _, v in vectors], float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = neighbours.exact_products(x, q)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, monkeypatch, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 2, (3000, 1)) if scale else 1
    x[::7] = x[0]  # a hot vector
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 200)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 60)
    vectors = list(enumerate(x.tolist()))
    want, got = brute(vectors, 20, 20), {}
    for r in run(spark, vectors):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for i, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        true = dict(want[i])
        hits += sum(v in true for _, v, _ in rows)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))
        assert all(true[v] == s for _, v, s in rows if v in true)
    assert hits >= 0.92 * 20 * len(want)


def test_odd_vectors(spark):
    v = [(0, [1, 2]), (1, [2, 1]), (2, [0, 0]), (3, None), (4, [float("nan"), 1]), (5, [1, None]), (6, [float("inf"), 1]), (7, []), (8, [1, 2, 3]), (None, [1, 1]), (20, [1, 2]), (20, [1, 2]), (21, [1, 2])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, v)]
    assert sorted(x for x in got if x[0] == 0) == [(0, 1, 20, 5.0), (0, 2, 20, 5.0), (0, 3, 21, 5.0), (0, 4, 1, 4.0)]
    assert {x[0] for x in got} == {0, 20} and all(x[2] != 20 for x in got if x[0] == 20)
    assert run(spark, []) == [] and run(spark, [(0, [1, 2])]) == []
