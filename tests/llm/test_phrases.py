from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import phrases


def plain(rows, width=13):
    words = [re.findall("[^\x20\x09-\x0d]+", r.text or "") for r in rows]
    ids = [r.doc_id if r.doc_id is not None else 2**63 - 1 for r in rows]
    least: dict[tuple, int] = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            least[t] = min(least.get(t, i), i)
    out = Counter()
    for r, i, w in zip(rows, ids, words):
        gone = {p for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[r.doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def test_hard_cases(docs, no_docs):
    assert Counter(tuple(r) for r in phrases.dedup_passages(docs).collect()) == plain(docs.collect())
    assert phrases.dedup_passages(no_docs).count() == 0


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain(docs.collect())
    assert Counter(tuple(r) for r in phrases.dedup_passages(docs).collect()) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 20


def test_shared_passages_of_all_lengths(spark):
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(400)]
    rows = []
    for i in range(300):
        at, n = rng.randrange(380), rng.choice([5, 12, 13, 14, 20, 60])
        filler = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        rows.append((rng.randrange(250), " ".join(filler + shared[at : at + n] + filler[::-1])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(tuple(r) for r in phrases.dedup_passages(docs).collect()) == plain(docs.collect())


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.integers(0, 3), max_size=80), among=st.integers(1, 12))
def test_every_window_holds_a_chosen_mark_and_equal_ones_the_same(words, among):
    marks = np.array(words, dtype=np.uint64)
    got = set(phrases.chosen(marks, among).tolist())
    seen: dict[tuple, set] = {}
    for k in range(len(words) - among + 1):
        inside = {p - k for p in got if k <= p < k + among}
        assert inside
        seen.setdefault(tuple(words[k : k + among]), inside)
        assert seen[tuple(words[k : k + among])] & inside
