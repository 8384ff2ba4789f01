from __future__ import annotations

import numpy as np
import pytest

from tallyspark.llm import topk


@pytest.mark.parametrize("block", [topk.BLOCK, 7])
def test_vectors_of_every_length_take_part(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    # The least id alone has an odd length.
    rows = [(0, [1.0, 2.0])] + [(i, [float(x) for x in rng.integers(-4, 5, (3, 5, 1)[i % 3])]) for i in range(1, 120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, v in rows[::10]:
        best = sorted((-int(256 * 256 * sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk.top_k_inner(vectors, vectors.filter("vec_id % 10 = 0")).collect()
    assert want and sorted(tuple(r) for r in got) == sorted(want)
