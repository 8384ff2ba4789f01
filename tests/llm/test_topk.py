from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tallyspark.llm import topk


@pytest.mark.parametrize("seed", range(12))
def test_threshold_algorithm_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 400)), int(rng.integers(1, 9))
    rows = rng.integers(-3, 4, (n, d))
    ids = rng.permutation(n * 3)[:n]
    query = rng.integers(-2, 3, d)
    order = np.argsort(rows, axis=0, kind="stable").T
    want = sorted(((int(r @ query), int(i)) for r, i in zip(rows, ids) if i != ids[0]), key=lambda x: (-x[0], x[1]))[:5]
    assert topk.threshold_top_k(rows, order, ids, query, int(ids[0]), 5) == want


def test_it_stops_early():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.integers(-5, 6, (5000, 8)), np.full((6, 8), 100)])

    class Watched(np.ndarray):
        seen = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Watched.seen += len(key)
            return super().__getitem__(key)

    topk.threshold_top_k(rows.view(Watched), np.argsort(rows, axis=0).T, np.arange(len(rows)), np.ones(8, dtype=int), -1, 5)
    assert Watched.seen < 1000


def test_hard_cases(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.0, 0.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (9, [2.0, 1.0]), (8, [2.0, 1.0]), (11, [-1.0, -1.0]), (300, [1.0]), (12, [1 / 3, 0.1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k_inner(vectors, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in (0, 50):  # each of the two rows of id 0 is a candidate of its own
        best = sorted((-sum(a * b for a, b in zip(dict(sound)[q], v)), i) for i, v in sound if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert [tuple(r) for r in got] == want
    none = vectors.limit(0)
    assert topk.top_k_inner(none, none).count() == 0
    assert topk.top_k_inner(vectors, none).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{path}'")
    vectors = spark.read.parquet(path)
    got = topk.top_k_inner(vectors, vectors.filter("vec_id % 50 = 0"))
    assert sorted(con.execute(topk.ORACLE).fetchall()) == sorted(tuple(r) for r in got.collect())


def test_the_best_so_far_is_carried_from_block_to_block():
    rng = np.random.default_rng(5)
    for trial in range(8):
        n, d = 900, int(rng.integers(1, 6))
        rows = rng.integers(-40, 41, (n, d)) * rng.integers(1, 50, (n, 1))
        rows = rows[np.argsort(-(rows**2).sum(axis=1), kind="stable")]
        ids = rng.permutation(2 * n)[:n]
        asked = rng.integers(-9, 10, (30, d))
        queries = topk.Queries(np.concatenate([ids[:15], -1 - np.arange(15)]), asked, 5)
        for a in range(0, n, 300):
            block = rows[a : a + 300]
            queries.meet(ids[a : a + 300], block, np.argsort(block, axis=0, kind="stable").T)
        for own, point, best in zip(queries.ids.tolist(), asked, queries.best):
            assert best == sorted(((int(r @ point), int(i)) for r, i in zip(rows, ids) if i != own), key=lambda x: (-x[0], x[1]))[:5]


def test_a_block_that_cannot_win_is_not_looked_at(monkeypatch):
    queries = topk.Queries(np.array([-1]), np.array([[1, 1]]), 2)
    high, low = np.array([[9, 9], [8, 8], [7, 7]]), np.array([[1, 2], [2, 1], [0, 0]])
    queries.meet(np.arange(3), high, np.argsort(high, axis=0).T)
    monkeypatch.setattr(topk.Queries, "_score", None)
    monkeypatch.setattr(topk, "threshold_top_k", None)
    queries.meet(np.arange(3, 6), low, np.argsort(low, axis=0).T)
    assert queries.best == [[(18, 0), (16, 1)]]
