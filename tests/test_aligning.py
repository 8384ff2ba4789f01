from __future__ import annotations

from collections import Counter

from tallyspark.operators import aligning

PRED = "doc_id long, row_group string, i int, field_key string, field_type string, rule string, pred_raw string"
GOLD = "doc_id long, row_group string, j int, field_key string, field_type string, rule string, gt_present boolean, gt_norm string"


def cell(doc, n, key, *rest, kind="STRING", group="g"):
    return (doc, group, n, key, kind, kind, *rest)


def sides(spark):
    """Two documents with partners and lone rows, one that only one side has, doubled cells, and nulls."""
    pred = [cell(1, 0, "name", "tea"), cell(1, 0, "sum", "1,00", kind="MONEY"), cell(1, 1, "name", "cake"), cell(1, 1, "odd", "x"), cell(1, 1, "name", "cakes"), cell(2, 0, "name", None), cell(3, 5, "name", "milk")]
    pred += [cell(None, 0, "name", "tea"), cell(1, None, "name", "tea"), (1, "g", 2, "sum", None, None, "7.00"), cell(1, 0, None, "tea")]
    gold = [cell(1, 0, "name", True, "cake"), cell(1, 1, "name", True, "tea"), cell(1, 1, "sum", True, "1.00", kind="MONEY"), cell(1, 2, "sum", True, None, kind="MONEY"), cell(1, 2, "name", False, None), cell(2, 0, "name", True, "")]
    gold += [cell(4, 0, "name", True, "rice"), cell(4, None, "name", True, "rice"), cell(1, 3, "sum", True, "7.00", kind="MONEY")]
    return spark.createDataFrame(pred, PRED), spark.createDataFrame(gold, GOLD)


def test_cells_of_aligned_rows(spark):
    got = aligning.aligned_cells(*sides(spark), 0.5, nfc=False)
    found = Counter((r.doc_id, r.row, r.field_key, r.pred_norm, r.gt_norm, r.outcome) for r in got.collect())
    assert found == Counter([
        (1, "p0", "name", "tea", "tea", "TP"), (1, "p0", "sum", "1.00", "1.00", "TP"), (1, "p0", None, "tea", None, "FP"),
        (1, "p1", "name", "cake", "cake", "TP"), (1, "p1", "name", "cakes", "cake", "TP"), (1, "p1", "odd", "x", None, "FP"),
        (1, "p2", "sum", None, None, "TN"), (1, "g3", "sum", None, "7.00", "FN"), (1, "g2", "sum", None, None, "EXCLUDED"), (1, "g2", "name", None, None, "TN"),
        (2, "p0", "name", None, None, "TN"), (2, "g0", "name", None, "", "TN"), (3, "p5", "name", "milk", None, "FP"), (4, "g0", "name", None, "rice", "FN"),
    ])


def test_each_side_is_read_once(spark):
    plan = aligning.aligned_cells(*sides(spark), 0.5, nfc=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Exchange ") <= 4
