"""Operators on groups that no task may hold whole: ranks, splits, fingerprints, passages in texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import leaking, profiling
from tallyspark.operators.ranking import ranked


def rows_of(seed: int, n: int):
    draw = random.Random(seed)
    names = [None, "", "a", "b", "hot"]
    return [(draw.choice([None, *range(n // 3)]), draw.choice(names) if i % 3 else "hot", draw.randrange(4)) for i in range(n)]


def test_ranks_match_a_sort(spark):
    rows = rows_of(1, 900)
    df = spark.createDataFrame(rows, "id long, grp string, rank int").withColumnRenamed("rank", "a.rank")
    got = ranked(df, [F.col("grp")], [F.col("id")]).collect()
    assert len(got) == len(rows)
    for name in {r[1] for r in rows}:
        mine = sorted((r for r in got if r.row.grp == name), key=lambda r: r["rank"])
        wanted = sorted((r[0] for r in rows if r[1] == name), key=lambda v: (v is not None, v or 0))
        assert [r["rank"] for r in mine] == list(range(len(wanted)))
        assert [r.row.id for r in mine] == wanted
        assert {r["size"] for r in mine} == {len(wanted)}
    assert ranked(df.limit(0), [], [F.col("id")]).count() == 0


def test_a_hot_group_is_ranked_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("grp"), F.col("id"))
    plan = ranked(df, [F.col("grp")], [F.col("id")])
    assert sorted(r["rank"] for r in plan.collect()) == list(range(4000))
    assert "range" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_split_takes_a_share_of_every_stratum(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "id long, grp string")
    got = profiling.seal_split(df, "id", ["grp"], 0.2, 7).collect()
    for name in ("hot", None):
        ids = sorted((hashlib.sha256(f"{r.id}/7".encode()).hexdigest(), r.id, r.side) for r in got if r.grp == name)
        assert [s for _, _, s in ids] == ["val"] * round(0.2 * len(ids)) + ["train"] * (len(ids) - round(0.2 * len(ids)))


def test_ids_go_on_after_the_known(spark):
    items = spark.createDataFrame([("b",), ("a",), ("c",), ("x",)], "key string")
    known = spark.createDataFrame([("b", "P-007")], "key string, id string")
    prefix = F.when(F.col("key") == "x", "Q-").otherwise("P-")
    got = {r.key: r.id for r in profiling.stable_ids(items, known, "key", prefix).collect()}
    assert got == {"b": "P-007", "a": "P-008", "c": "P-009", "x": "Q-001"}


def test_ids_above_three_digits_keep_all_of_them(spark):
    items = spark.createDataFrame([("a",), ("b",)], "key string")
    known = spark.createDataFrame([("z", "P-999")], "key string, id string")
    got = {r.key: r.id for r in profiling.stable_ids(items, known, "key", F.lit("P-")).collect()}
    assert got == {"a": "P-1000", "b": "P-1001"}


def test_fingerprints_are_of_sorted_names(spark):
    rows = rows_of(2, 700)
    df = spark.createDataFrame(rows, "id long, grp string, other int")
    got = {r.grp: r.fingerprint for r in profiling.fingerprint(df, "id", "grp").collect()}
    wanted = {g: hashlib.sha256("\n".join(sorted(str(r[0]) for r in rows if r[1] == g and r[0] is not None)).encode()).hexdigest() for g in {r[1] for r in rows}}
    assert got == wanted
    assert len(profiling.fingerprint(df, "id").collect()) == 1


@pytest.mark.parametrize("seed", range(3))
def test_passages_match_brute_force(spark, seed):
    draw = random.Random(seed)
    words = ["aa", "b", "ccc", "dd", "é", "f.g"]
    gaps = [" ", " ", "  ", "\n", "\t "]

    def text(n):
        return "".join(draw.choice(words) + draw.choice(gaps) for _ in range(n))

    texts = [(i, text(draw.randrange(60))) for i in range(60)] + [(7, text(30)), (None, text(40)), (None, text(40)), (90, None), (91, "")]
    texts += [(100 + i, texts[3][1]) for i in range(40)]
    cut = lambda s: s[(a := draw.randrange(len(s) + 1)) : a + draw.choice([2, 6, 14, 40])]
    passages = [(i, cut(draw.choice(texts)[1] or "")) for i in range(50)] + [(3, text(3)), (60, None), (61, " "), (62, text(9))]
    passages = [(i, p) for i, p in passages if p is None or len(p) > 1]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("item", F.lit("extra"))
    items = spark.createDataFrame(passages, "item long, passage string")
    got = {(r.id, r.item) for r in leaking.passages_in(docs, items, "id", "text", "item", "passage").collect()}
    wanted: dict = {}
    for i, t in texts:
        for k, p in passages:
            if t is not None and p is not None and p in t:
                wanted[i] = min(wanted.get(i, k), k)
    assert got == set(wanted.items())


def test_no_texts_or_no_passages(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item long, passage string")
    assert leaking.passages_in(docs.limit(0), items, "id", "text", "item", "passage").count() == 0
    assert leaking.passages_in(docs, items.limit(0), "id", "text", "item", "passage").count() == 0
