from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing, sharding, token_output
from tallyspark.llm.scratch import Scratch
from tallyspark.llm.tokens import encoder

from .conftest import texts

FILES = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]


LIBRARY = {p: Tokenizer.from_file(p) for p in FILES}


def whole(path: str, text: str | None) -> bytes:
    ids = LIBRARY[path].encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("path", FILES)
def test_cached_encoding_is_that_of_the_whole_text(path):
    for text in texts():
        assert encoder(path).encode(text) == whole(path, text), text


@pytest.mark.parametrize("path", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("abE.,'s \n\t\r\x1c éß1中😀́İΣ"), max_size=30))
def test_cached_encoding_of_any_text(path, text):
    ids = LIBRARY[path].encode(text, add_special_tokens=False).ids
    assert encoder(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_token_output(spark, docs, no_docs):
    scratch = Scratch(spark, "t")
    token_output.write_token_table(docs, scratch.path("a"), FILES[0], end_id=1)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.token_digest(spark, scratch.path("a")).collect())
    rows = docs.collect()
    blobs = [(r.doc_id, whole(FILES[0], r.text) + b"\1\0\0\0") for r in rows]
    assert Counter((d, len(b) // 4, zlib.crc32(b)) for d, b in blobs) == Counter(x[1:] for x in got)
    start = 0
    for at, _, n, _ in got:
        assert at == start
        start += n
    ids = [x[1] for x in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    some = token_output.read_token_table(spark, scratch.path("a")).filter("doc_id = 15").select("ids").first().ids
    assert struct.pack(f"<{len(some)}I", *some) == whole(FILES[0], texts()[15]) + b"\1\0\0\0"
    token_output.write_token_table(no_docs, scratch.path("b"), FILES[0], end_id=1)
    assert token_output.token_digest(spark, scratch.path("b")).count() == 0


def test_packing(docs, no_docs):
    limit = 64
    got = packing.pack_best_fit(docs, FILES[1], 0, limit).collect()
    want = Counter()
    for r in docs.collect():
        blob = whole(FILES[1], r.text) + bytes(4)
        n, start, piece = len(blob) // 4, 0, 0
        while start < n:
            size = (n % limit or limit) if start == 0 else limit
            want[r.doc_id, piece, start, size, zlib.crc32(blob[4 * start : 4 * (start + size)])] += 1
            start, piece = start + size, piece + 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    assert len(by) <= -(-sum(r.length for r in got) // limit) + 2
    assert packing.pack_best_fit(no_docs, FILES[1]).count() == 0


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), max_size=200))
def test_bulk_best_fit_is_best_fit_decreasing(lengths):
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(40 - length)
    used = Counter()
    placed = Counter()
    for length, a, b, first, offset in packing.best_fit_plan(dict(Counter(lengths)), 40):
        placed[length] += b - a
        for s in range(first, first + b - a):
            assert used[s] == offset
            used[s] += length
    assert placed == Counter(lengths)
    assert len(used) == len(gaps)


def test_sharding(spark, docs, no_docs):
    got = sharding.shard_by_bytes(docs, 3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2}
    assert sharding.shard_by_bytes(no_docs, 3).count() == 0


def test_items_go_where_the_dot_product_is_highest():
    rng = random.Random(2)
    for _ in range(30):
        shards = rng.randint(1, 6)
        items = [[rng.randint(1, 90), rng.randint(1, 30), rng.randint(1, 9)] for _ in range(rng.randint(0, 40))]
        totals = [max(1, sum(i[d] for i in items)) for d in range(3)]
        left, want = [[1.0] * 3 for _ in range(shards)], {}
        for k in sorted(range(len(items)), key=lambda k: (-items[k][0], k)):
            share = [items[k][d] / totals[d] * shards for d in range(3)]
            fits = [s for s in range(shards) if left[s][0] >= share[0] / 2]
            score = (lambda s: sum(a * b for a, b in zip(left[s], share))) if fits else (lambda s: left[s][0])  # noqa: B023
            best = max(fits or range(shards), key=lambda s: (round(score(s), 9), -s))
            want[k] = score(best)
            got = int(sharding.place_items(np.array(items).reshape(-1, 3), shards)[k])
            assert got in (fits or range(shards)) and score(got) == pytest.approx(want[k])
            left[got] = [a - b for a, b in zip(left[got], share)]


def test_groups_up_to_a_shard_stay_together(spark):
    rows = [(i, "nearly a shard " * 40 if i < 30 else f"text {i} " * 30) for i in range(2000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    shards_of, sizes = defaultdict(set), Counter()
    for r in got:
        shards_of[r.text_crc32].add(r.shard)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in shards_of.values()) and max(sizes.values()) < 1.02 * sum(sizes.values()) / 24


def test_the_files_are_laid_out_as_said(spark):
    import pyarrow.parquet as pq

    scratch = Scratch(spark, "layout")
    rows = [(i, f"text of number {i} " * 30) for i in range(6000)]
    token_output.write_token_table(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), scratch.path("a"), FILES[0], end_id=1)
    found = [f for f in spark.read.parquet(scratch.path("a")).inputFiles()]
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found]
    assert sum(m.num_rows for m in metas) == 6000
    for meta in metas:
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 80 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index
                assert any("DICTIONARY" in e for e in column.encodings) == column.path_in_schema.startswith("ids")
                assert column.path_in_schema.startswith("ids") or "DELTA_BINARY_PACKED" in column.encodings


def test_a_third_of_all_rows_alike_stays_balanced(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sizes = Counter()
    shards_of = defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        shards_of[r.text_crc32].add(r.shard)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert sum(len(s) > 1 for s in shards_of.values()) <= 1
