from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import substrings


def plain(rows, length=200):
    texts = [(r.text or "").encode() for r in rows]
    seen = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] += 1
    out, left = Counter(), []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[r.doc_id, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
        left.append((r.doc_id, None if r.text is None else kept.decode(errors="ignore")))
    return out, Counter(left)


def check(docs):
    want, left = plain(docs.collect())
    assert Counter(tuple(r) for r in substrings.dedup_substrings(docs).collect()) == want
    kept = substrings.drop_repeated_substrings(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == left
    return want


def test_hard_cases(docs, no_docs):
    assert sum(n for (_, _, gone, _, _), n in check(docs).items() if gone)
    assert substrings.dedup_substrings(no_docs).count() == 0
    assert substrings.drop_repeated_substrings(no_docs).count() == 0


def test_against_brute_force(spark):
    assert check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120))


@pytest.mark.parametrize("hot", [1000, 3])
def test_shared_passages_of_all_lengths(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    shared = "".join(rng.choice("abcdefghé ") for _ in range(3000))
    rows = []
    for i in range(250):
        at, n = rng.randrange(2500), rng.choice([50, 198, 199, 200, 201, 240, 500])
        filler = "".join(rng.choice("xyz") for _ in range(rng.randrange(300)))
        rows.append((i, filler + shared[at : at + n] + filler[::-1] + ("ab" * rng.randrange(150) if i % 10 == 0 else "")))
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_runs_of_one_character(spark):
    assert check(spark.createDataFrame([(1, "a" * 700), (2, "a" * 200), (3, "b" * 199), (4, "c" * 200), (5, "ab" * 300 + "d" * 230)], "doc_id long, text string"))


def test_clipping_loses_no_string():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(3, 8)
        anchors, contexts, lefts = [], [], []
        for _ in range(rng.randint(1, 12)):
            left = rng.randint(0, 6)
            anchors.append(rng.randint(-1, 1))
            contexts.append(bytes(rng.choice(b"ab") for _ in range(left)) + b"GRAM" + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6))))
            lefts.append(left)
        parts = substrings.clips(anchors, contexts, lefts, length)
        strings = [{(i, c[a : a + length], a - n) for a in range(len(c) - length + 1)} for i, (c, n) in enumerate(zip(contexts, lefts))]
        for i, (c, n, (a, b)) in enumerate(zip(contexts, lefts, parts)):
            others = {(s, at) for j, found in enumerate(strings) if j != i and anchors[j] == anchors[i] for _, s, at in found}
            for o in range(len(c) - length + 1):
                if o <= n and o + length >= n and (c[o : o + length], o - n) in others:
                    assert a <= o and o + length <= b
