from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers

from tallyspark.llm import sampling

from .conftest import texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(vocab, text):
    """All segmentations of ``text`` with their log-weights, by brute force."""
    sp = vocab.model
    normal = sp.normalize(text)
    size = sp.get_piece_size()
    norm = math.log(sum(1 / (r + 2.7) for r in range(size)))
    usable = lambda p: (i := sp.piece_to_id(p)) and not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)) and (sp.get_score(i) > sampling.NEVER or len(p) == 1) and "▁" not in p[1:]
    out = {}

    def go(at, ids, weight):
        if at == len(normal):
            out[tuple(ids)] = weight
            return
        for end in range(at + 1, len(normal) + 1):
            if usable(normal[at:end]):
                i = sp.piece_to_id(normal[at:end])
                go(end, [*ids, i], weight - math.log(min(-sp.get_score(i), size) + 2.7) - norm)
        if not usable(normal[at]):
            data = normal[at].encode()
            go(at + 1, [*ids, *(sp.piece_to_id(f"<0x{b:02X}>") for b in data)], weight + len(data) * vocab.worst)

    go(0, [], 0.0)
    total = math.log(sum(math.exp(w - max(out.values())) for w in out.values())) + max(out.values())
    return {ids: w - total for ids, w in out.items()}


def seeds(n, start=0):
    return sampling.mix(np.arange(start, start + n, dtype=np.uint64))


def test_samples_are_distinct_segmentations_with_their_probability():
    vocab = sampling.vocabulary(MODEL, 1.0)
    for text in ["the", "a b", "tea 😀", "on the", "", "x"]:
        truth = every(vocab, text)
        for rows in sampling.sample_batch(vocab, [text] * 20, seeds(20), 6):
            got = [tuple(r[0].tolist()) for r in rows]
            assert len(set(got)) == len(got) == min(6, len(truth))
            assert all(abs(r[1] - truth[g]) < 1e-9 for r, g in zip(rows, got))
            assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
            assert all(r[3] <= 0 for r in rows) and (len(truth) > 6 or all(r[3] == 0 for r in rows))


def test_ordered_samples_follow_sampling_without_replacement():
    vocab = sampling.vocabulary(MODEL, 0.5)
    text, n = "tea", 20000
    truth = {k: math.exp(v) for k, v in _half(vocab, text).items()}
    seen = Counter(tuple(tuple(r[0].tolist()) for r in rows) for rows in sampling.sample_batch(vocab, [text] * n, seeds(n, 7), 2))
    for a, b in itertools.permutations(truth, 2):
        p = truth[a] * truth[b] / (1 - truth[a])
        assert abs(seen[a, b] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def _half(vocab, text):
    """Brute force under half the exponent."""
    whole = every(sampling.vocabulary(MODEL, 1.0), text)
    total = math.log(sum(math.exp(w / 2) for w in whole.values()))
    return {k: w / 2 - total for k, w in whole.items()}


def test_inclusion_scores_estimate_sums_without_bias():
    vocab = sampling.vocabulary(MODEL, 1.0)
    truth = every(vocab, "on tea")
    pieces = sum(math.exp(w) * len(ids) for ids, w in truth.items())
    n = 4000
    estimates = [sum(math.exp(r[1] - r[3]) * len(r[0]) for r in rows) for rows in sampling.sample_batch(vocab, ["on tea"] * n, seeds(n, 99), 3)]
    assert abs(np.mean(estimates) - pieces) < 5 * np.std(estimates) / math.sqrt(n)


def test_hard_cases(spark, docs, no_docs):
    got = sampling.sample_segmentations(docs, MODEL, k=2, with_ids=True).collect()
    again = sampling.sample_segmentations(docs.repartition(3), MODEL, k=2).collect()
    assert Counter(tuple(r[:7]) for r in got) == Counter(tuple(r[:7]) for r in again)
    model = sampling.vocabulary(MODEL, 1.0).model
    decoded = Counter((r.doc_id, model.decode(r.ids)) for r in got if r.sample == 0)
    assert decoded == Counter((r.doc_id, model.decode(model.encode(r.text or ""))) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault((r.doc_id, model.decode(r.ids)), set()).add(tuple(r.ids))
    assert all(len(v) == 2 for (i, t), v in by.items() if i is not None and len(texts()[i] or "") > 5 and i != 5)
    assert sampling.sample_segmentations(no_docs, MODEL).count() == 0


def test_shares_of_words_and_texts_change_nothing(monkeypatch):
    vocab = sampling.vocabulary(MODEL, 1.0)
    given = [t or "" for t in texts()]
    plain = lambda batch: [[(r[0].tolist(), *r[1:]) for r in rows] for rows in batch]
    whole = plain(sampling.sample_batch(vocab, given, seeds(len(given)), 2))
    monkeypatch.setattr(sampling, "WORDS", 5)
    monkeypatch.setattr(sampling, "TOGETHER", 2)
    assert plain(sampling.sample_batch(vocab, given, seeds(len(given)), 2)) == whole
    assert all(vocab.round_trip(np.array(ids, dtype=np.int64), t) == (vocab.model.decode(ids) == t) for t, rows in zip(given, whole) for ids, *_ in rows)
