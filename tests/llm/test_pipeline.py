from __future__ import annotations

from collections import Counter

import corpus_pipeline

from . import test_quality, test_simhash, test_substrings

PATH = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").cache()
    (_, rules), (_, near), (_, repeats), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, PATH).cache()
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if test_quality.plain(r.text)[-1])

    rows = kept.collect()
    prints = {r.doc_id: test_simhash.plain_fingerprint(r.text) for r in rows}
    distinct = sorted(set(prints.values()))
    roots = test_simhash.components(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least: dict[int, int] = {}
    for doc_id, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], doc_id), doc_id)
    unlike = near(spark, kept, PATH).cache()
    assert unlike.schema == docs.schema
    assert sorted(r.doc_id for r in unlike.collect()) == sorted(least.values())

    cut = repeats(spark, unlike, PATH).cache()
    assert cut.columns == docs.columns
    _, left = test_substrings.plain(unlike.collect())
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == left
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    packed = pack(spark, cut, PATH).cache()
    tokens = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in tokens) <= 2048 and len(tokens) <= -(-sum(r[1] for r in tokens) // 2048) + 2
    whole = corpus_pipeline.run(spark, PATH)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in whole.select(columns).collect()) == Counter(tuple(r) for r in packed.select(columns).collect())
