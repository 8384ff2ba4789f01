from __future__ import annotations

import random

import pytest


def texts() -> list[str | None]:
    """Short hard cases: null, empty, white space, copies, long words and texts, many scripts."""
    rng = random.Random(7)
    words = ["the", "of", "Über", "élan", "don't", "a,", "b.", "x", "ß", "naïve", "中文", "😀", "42nd", "|", "#"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))
    long = prose(3000)
    return [
        None, "", " ", "\n\n", "a", "a b", "  lead and  double  blanks ", "tabs\tand\r\nlines\n\nmore \n x", "nb sp ace \x1c sep", "İstanbul ǅ ﬁ é ΣΑΣ", "<|endoftext|> in text",
        "y" * 500, long, long, long + " tail", prose(40), prose(400), prose(400), "It's 'sly we'll 've",
    ]


@pytest.fixture
def docs(spark):
    """Nulls and ties in the id, repeated rows, and extra columns of clashing names."""
    rows = [(i, t, "shard", i % 3, None) for i, t in enumerate(texts())]
    rows += [rows[13], rows[13], (5, "another text of one id", None, 1, None), (None, "no id", None, 2, None), (None, None, None, 2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, length int, part int")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
