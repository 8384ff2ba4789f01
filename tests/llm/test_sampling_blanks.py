from __future__ import annotations

import math

import numpy as np
import pytest

from tallyspark.llm import sampling

from .test_sampling import MODEL, seeds


def every(vocab, text):
    """All segmentations of ``text`` with their log-probability, pieces of several blanks among them."""
    sp = vocab.model
    normal, size = sp.normalize(text), sp.get_piece_size()
    norm = math.log(sum(1 / (r + 2.7) for r in range(size)))
    ways = {len(normal): {(): 0.0}}
    for at in range(len(normal) - 1, -1, -1):
        ways[at] = {}
        for end in range(at + 1, len(normal) + 1):
            p = normal[at:end]
            i = sp.piece_to_id(p)
            if sp.is_unknown(i) or (p.strip("▁") and ("▁" in p[1:] or sp.get_score(i) <= sampling.NEVER and len(p) > 1)):
                continue
            w = -math.log(min(-sp.get_score(i), size) + 2.7) - norm
            ways[at] |= {(i, *rest): w + v for rest, v in ways[end].items()}
    total = math.log(sum(map(math.exp, ways[0].values())))
    return {ids: w - total for ids, w in ways[0].items()}


@pytest.mark.parametrize("text", ["a  b", " a", "a   ", "a b    c", "  ", "x =        y"])
def test_runs_of_blanks(text):
    vocab = sampling.vocabulary(MODEL, 1.0)
    truth = every(vocab, text)
    assert tuple(vocab.model.encode(text)) in truth
    k = min(len(truth), 40)
    for rows in sampling.sample_batch(vocab, [text] * 5, seeds(5), k):
        got = [tuple(r[0].tolist()) for r in rows]
        assert len(set(got)) == len(got) == k
        assert all(abs(r[1] - truth[g]) < 1e-9 for r, g in zip(rows, got))
    if len(truth) == k:  # all of them, so also the model's own
        assert set(got) == set(truth)


def test_the_encoders_own_segmentation_is_drawn():
    vocab = sampling.vocabulary(MODEL, 1.0)
    own = tuple(vocab.model.encode("a     b"))
    assert any(len(p) > 1 and not p.strip("▁") for p in vocab.model.encode("a     b", out_type=str))
    rows = sampling.sample_batch(vocab, ["a     b"], np.array([5], dtype=np.uint64), 200)[0]
    assert own in {tuple(r[0].tolist()) for r in rows}
