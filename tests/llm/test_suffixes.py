from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import suffixes


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.integers(1, 4), max_size=60), buckets=st.booleans())
def test_suffix_array_and_prefixes_of_small_texts(text, buckets):
    t = np.array([*text, 0])
    try:
        suffixes.LARGE_BUCKET = 0 if buckets else 10**9
        sa = suffixes.suffix_array(t)
    finally:
        suffixes.LARGE_BUCKET = 400
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want
    plcp = suffixes.permuted_common_prefixes(t, sa, 10)
    for before, at in zip(want, want[1:]):
        n = 0
        while n < 10 and max(at, before) + n < len(t) and t[at + n] == t[before + n]:
            n += 1
        assert plcp[at] == n
    assert plcp[want[0]] == 0


@pytest.mark.parametrize("make", ["random", "copies", "run"])
def test_long_texts(make):
    rng = random.Random(4)
    text = [rng.randrange(2, 30) for _ in range(20_000)] if make == "random" else [rng.randrange(2, 250) for _ in range(900)] * 30 if make == "copies" else [5] * 20_000
    t = np.array([*text, 0])
    sa = suffixes.suffix_array(t)
    raw = bytes(x for x in text) + b"\0"
    some = sa[:: max(1, len(sa) // 2000)]
    assert sorted(sa.tolist()) == list(range(len(t)))
    assert all(raw[a:] < raw[b:] for a, b in zip(some, some[1:]))
