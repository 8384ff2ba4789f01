from __future__ import annotations

import re
from collections import Counter

import duckdb

from tallyspark.llm import quality


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    more = m | {"n_lines": len(lines), "n_stop_words": sum(w in quality.STOP_WORDS for w in words)}
    good = True
    for _, measure, scale, by, low, high in quality.RULES:
        per = more[by] if by else 1
        good &= (low is None or scale * more[measure] >= low * per) and (high is None or scale * more[measure] <= high * per)
    return (*m.values(), base, not base and good)


def test_hard_cases(docs, no_docs):
    got = quality.quality_rules(docs).collect()
    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert Counter(tuple(r) for r in got) == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in docs.collect() if plain(r.text)[-1])
    assert quality.quality_rules(no_docs).count() == 0


def test_no_user_functions(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    got = quality.quality_rules(spark.read.parquet(path))
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({quality.ORACLE})").fetchall()
    assert Counter(rows) == Counter(tuple(r) for r in got.collect())
