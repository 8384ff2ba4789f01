from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.components import _large_star, _small_star, connected_components
from tallyspark.llm.scratch import Scratch


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def check(docs, got):
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    distinct = sorted(set(prints))
    roots = components(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    ids = defaultdict(list)
    for r, p in zip(rows, prints):
        ids[roots[p]] += [r.doc_id] if r.doc_id is not None else []
    want = Counter((r.doc_id, f"{p:016x}", min(ids[roots[p]], default=None)) for r, p in zip(rows, prints))
    assert want == Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect())
    return {roots[p] for p in prints}


def test_hard_cases(docs, no_docs):
    groups = check(docs, simhash.simhash_near_duplicates(docs))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert simhash.simhash_near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, simhash.simhash_near_duplicates(docs))


@pytest.mark.parametrize("n", [10, 3000, 200_000, 5_000_000, 10**9])
def test_covering_finds_every_pair_once(n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(20)]
    prints = np.array(sorted(set(base + near)), dtype=np.uint64)
    blocks = simhash.code_blocks(n)
    assert sum(blocks) <= 64 and all(b % 2 for b in blocks)
    home, who, where = simhash.anchors(prints, blocks, 2)
    assert len(set(zip(who.tolist(), where.tolist()))) == len(who)
    at = defaultdict(list)
    for i, a in zip(who.tolist(), where.tolist()):
        at[a].append(i)
    found = Counter((i, j) for i, a in enumerate(home.tolist()) for j in at[a] if i < j and (int(prints[i]) ^ int(prints[j])).bit_count() <= 2)
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert want and found == Counter(want)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(-5, 7), (300, 300)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] * 2
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in got} == components(nodes, [e for e in edges if e[0] != e[1]])


def test_visits_are_never_broadcast(spark):
    scratch = Scratch(spark, "test")
    nodes = scratch.write(spark.range(300).select(F.xxhash64("id").alias("fp")), "nodes")
    edges = scratch.write(spark.range(50).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi")), "edges")
    for plan in (simhash.links(nodes, 300, 2), _large_star(edges), _small_star(edges)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_components_or_keepers_is_broadcast(spark, docs, monkeypatch):
    made, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, **options: made.append(df) or write(self, df, name, **options))
    made.append(simhash.drop_near_duplicates(docs))
    assert len(made) > 6
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
