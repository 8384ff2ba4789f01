"""Extra columns of clashing and odd names, and very long texts, through every stage that returns documents."""

from __future__ import annotations

import random

import pyarrow as pa

from tallyspark.llm import quality, scratch, simhash, substrings

ODD = ["of", "__of", "__n", "ours", "n", "spans", "__spans", "__m", "measures", "key_id", "key_hash", "a", "b", "A.b", "x y", "row", "fp", "`q`"]


def test_clashing_names_stay_as_they_are(spark):
    prose = "the quick brown fox and the lazy dog of the day is in the house that was on a hill " * 4
    rows = [(i, f"{prose} number {i}") for i in range(3)] + [(7, None), (8, ""), (0, f"{prose} number 0")]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in ODD]) for r in rows], "doc_id long, text string, " + ", ".join(scratch.quoted(c) + " string" for c in ODD))
    for stage in (quality.keep_good, simhash.drop_near_duplicates, substrings.drop_repeated_substrings):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert list(r)[2:] == [f"{c}{r[0]}" for c in ODD]
    assert simhash.drop_near_duplicates(docs).count() <= 4


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 2_000_000] * 40 + ["y"] * 3000 + ["z" * 30_000_000]})
    pieces = list(scratch.sliced([batch]))
    assert sum(map(len, pieces)) == len(batch)
    assert all(len(p) <= 1000 and (len(p) == 1 or p.nbytes <= 8 << 20) for p in pieces)
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))


def test_long_texts_are_packed_whole(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    from tallyspark.llm import packing

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(350_000))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))
    packed = packing.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("m")).filter("n = m").count() == 20
