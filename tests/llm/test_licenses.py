from __future__ import annotations

import re
from collections import Counter

import duckdb

from tallyspark.llm import licenses


def plain(text):
    pieces = re.sub(r"[.!?]+([ \t\r\n]|\Z)", "\n", text or "").split("\n")
    said = [s for s in (re.sub("[^a-z0-9]+", " ", re.sub("[^A-Za-z0-9]+", " ", p).lower()).strip() for p in pieces) if s]
    by = {s: k for k, s in licenses.SENTENCES.items()}
    ids = [by.get(s, 0) for s in said]
    runs = [k for i, k in enumerate(ids) if k or i == 0 or ids[i - 1]]
    for n, (name, rule) in enumerate(licenses.RULES, 1):
        if any(tuple(runs[i : i + len(rule)]) == rule for i in range(len(runs))):
            return len(ids), sum(k > 0 for k in ids), f",{','.join(map(str, runs))},", n, name
    return len(ids), sum(k > 0 for k in ids), f",{','.join(map(str, runs))},", None, None


CASES = [
    "Released under the MIT License.\nMore text.", "Licensed under CC BY-NC 4.0.", "text. Licensed under the Apache License, Version 2.0! All rights reserved.",
    "Neither sentence is known. At all?", "The mit license", "Released\nunder the MIT License",
    ". ".join(licenses.SENTENCES[k] for k in (14, 15, 16, 17)), ". ".join(licenses.SENTENCES[k] for k in (14, 15, 16)) + ". Between. " + licenses.SENTENCES[17],
]


def test_hard_cases(spark, docs, no_docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(CASES)], "doc_id long, text string"))
    got = licenses.scan_licenses(more).collect()
    assert Counter(tuple(r) for r in got) == Counter((r.doc_id, *plain(r.text)) for r in more.collect())
    named = {r.doc_id - 100: r.license for r in got if (r.doc_id or 0) >= 100}
    assert named == {0: "MIT", 1: "CC-BY-NC-4.0", 2: "Apache-2.0", 3: None, 4: None, 5: None, 6: "BSD-3-Clause", 7: "BSD-2-Clause"}
    assert licenses.scan_licenses(no_docs).count() == 0
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    got = licenses.scan_licenses(spark.read.parquet(path))
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({licenses.ORACLE})").fetchall()
    assert Counter(rows) == Counter(tuple(r) for r in got.collect()) and any(r[-1] for r in rows)
