from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyspark.sources import annotations as A


def test_tagged_tokens(spark, tmp_path):
    df = spark.createDataFrame([("a", (b"xyz", "Template3_Instance07.JPG"), ["t", "u"], [2, 1, 2], [[1, 2]]), ("b", (b"", "odd.png"), [], [], [])], "id string, image struct<bytes:binary,path:string>, tokens array<string>, ner_tags array<int>, bboxes array<array<int>>")
    got = A.tagged_tokens(df, image_bytes=True).orderBy("id").collect()
    assert (got[0].template_id, got[0].instance_id, got[0].n_tokens, got[0].tags, got[0].n_bytes) == ("3", 7, 2, [1, 2], 3)
    assert got[1].template_id is None and got[1].instance_id is None
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert A.parquet_index(spark, str(tmp_path / "p")).first().n_rows == 2


def test_receipts(spark):
    rows = [json.dumps({"gt_parse": {"menu": [{"nm": 1}, {"nm": 2}], "total": {"total_price": "9,00"}}}), json.dumps({"gt_parse": {"menu": {"nm": 1}, "total": {"total_price": 9}}}), json.dumps({"gt_parse": {}}), "{"]
    got = A.receipts(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, ground_truth string")).orderBy("id").collect()
    assert [(r.n_items, r.total_price, r.malformed) for r in got] == [(2, "9,00", False), (1, None, False), (0, None, False), (0, None, True)]
    assert got[0]["keys"] == ["menu", "total"]


def test_forms_and_labels(spark):
    form = [("q", ["a", "b"], [[0, 1]], "question"), ("x", ["c"], [], "answer"), ("y", [], [], "answer")]
    df = spark.createDataFrame([("s", form)], "stem string, form array<struct<text:string,words:array<string>,linking:array<array<int>>,label:string>>")
    got = A.forms(df)
    r = got.first()
    assert (r.n_entities, r.n_words, r.n_links, r.n_question, r.n_answer, r.labels) == (3, 3, 1, 1, 2, {"question": 1, "answer": 2})
    assert [(x.label, x.n) for x in A.label_totals(got).collect()] == [("answer", 2), ("question", 1)]


def test_invoice_fields_and_layouts(spark):
    df = spark.createDataFrame([("s", "[3, 4, 1]", [(("k",), ("total", "v"))]), ("t", "odd", None)], "stem string, image_dims string, Fields array<struct<key:struct<tag:string>,value:struct<label:string,tag:string>>>")
    got = {r.stem: r for r in A.invoice_fields(df, {"total": "Total"}).collect()}
    assert got["s"].dims == [3, 4, 1] and got["s"].documented == "Total" and got["t"].dims is None
    schema = "page_info struct<image_path:string,page_no:int,width:int,height:int,page_attribute:struct<language:string,data_source:string,layout:string,special_issue:array<string>>>, layout_dets array<struct<category_type:string>>"
    pages = A.page_layouts(spark.createDataFrame([(("p", 1, 2, 3, ("en", "d", "l", ["x"])), [("text",), ("table",), ("text",)]), (("q", 1, 2, 3, ("en", "d", "l", [])), [("text",)])], schema))
    assert [(r.category, r.n_pages) for r in A.category_counts(pages).collect()] == [("text", 2), ("table", 1)]


def test_answers(spark):
    text = "(main question): 12 EUR\n(note): first\nline\n(note): last\nSources: [1, 2]"
    got = spark.createDataFrame([(text,)], "t string").select(A.answer_sections(F.col("t")).alias("m")).first().m
    assert got == {"main question": "12 EUR", "note": "last", "Sources": "[1, 2]"}
