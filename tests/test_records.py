"""Records taken apart once each: fields, rates of the record's own rows, pages merged, work dealt out."""

from __future__ import annotations

from tallyspark.operators import structuring, truth
from tallyspark.plans.inputs import spread

SAID = '{"SELLER_NAME": "x", "seller_name": " Café ", "tax_rate": null, "buyer_name": ["x"], "VAT_breakdown": [{"rate_percent": "7,0 %"}, "no row", {"Rate_Percent": 7}]}'


def parses(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") + df._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs")


def test_a_record_is_parsed_once_for_all_fields(spark):
    docs = spark.createDataFrame([(1, SAID), (2, "no object"), (3, None)], "id long, json string")
    found = structuring.parsed(docs, "json", ["id"])
    assert parses(found) < 12 and parses(truth.from_json(docs, "json", "id")) < 12
    rows = found.collect()
    assert len(rows) == 3 * len(structuring.KEYS)
    assert {(r.id, r.field_key): r.pred_norm for r in rows if r.pred_norm is not None} == {(1, "seller_name"): "Café", (1, "tax_rate"): "7"}
    stored = truth.from_json(docs, "json", "id").filter("gt_present").collect()
    assert [(r.id, r.field_key, r.gt_raw, r.gt_norm) for r in stored] == [(1, "seller_name", " Café ", "Café")]


def test_pages_bring_only_cells_with_a_value_together(spark):
    pages = [("a", 2, '{"seller_name": "late", "tax_rate": 5}'), ("a", 1, '{"seller_name": "first"}'), ("b", 1, "{}"), (None, 1, '{"buyer_name": "n"}')]
    merged = structuring.parsed_pages(spark.createDataFrame(pages, "doc string, page int, json string"), "json", ["doc"], "page")
    rows = merged.collect()
    assert len(rows) == 3 * len(structuring.KEYS)
    assert {(r.doc, r.field_key): r.pred_norm for r in rows if r.pred_norm is not None} == {("a", "seller_name"): "first", ("a", "tax_rate"): "5", (None, "buyer_name"): "n"}
    assert "isnotnull" in merged._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_small_file_is_dealt_to_many_tasks(spark):
    assert spread(spark, "/root/testdata/sf0.001", "SELECT o_orderkey FROM {orders}").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
