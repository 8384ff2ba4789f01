"""Outcomes of predicted cells against stored ones, and the metrics over them.

The long table ``cells`` is what everything else reads: one row for each model, document and field with
``field_type``, ``rule``, ``gt_present``, ``gt_norm`` and ``pred_raw``. A stored cell is absent (not
present), empty (present, ''), rejected (present, null) or has content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import apply_rule
from ..functions.similarity import nls

OUTCOMES = ["TP", "FP", "FN", "TN", "EXCLUDED"]


def read_predictions(cells: DataFrame, nfc: bool = True) -> DataFrame:
    """``cells`` with ``pred_norm``, the canonical form of ``pred_raw``, and ``nls``, its similarity for free text."""
    read = cells.withColumn("pred_norm", apply_rule(F.col("rule"), F.col("pred_raw"), nfc))
    return read.withColumn("nls", F.when((F.col("field_type") == "STRING") & (F.col("gt_norm") != ""), nls(F.col("pred_norm"), F.col("gt_norm"))))


def judge(cells: DataFrame, threshold: Column | float = 0.5) -> DataFrame:
    """``outcome`` and ``score`` of read cells: a projection, so any number of thresholds costs no new pass."""
    gt, pred, kind = F.col("gt_norm"), F.col("pred_norm"), F.col("field_type")
    text = kind == "STRING"
    hit = F.when(text, (F.col("nls") >= threshold) & (F.col("nls") > 0)).otherwise(gt == pred)
    outcome = (
        F.when(~F.col("gt_present"), F.when(pred.isNull(), "TN").otherwise("FP"))
        .when(gt.isNull(), "EXCLUDED")
        .when(gt == "", F.when(F.coalesce(pred, F.lit("")) == "", "TN").otherwise("FN"))
        .otherwise(F.when(F.coalesce(hit, F.lit(False)), "TP").otherwise("FN"))
    )
    judged = cells.withColumn("outcome", outcome)
    content = F.col("gt_present") & (gt != "")
    score = F.when(F.col("outcome") == "TN", 1.0).when(content & text, F.coalesce("nls", F.lit(0.0))).when(F.col("outcome") == "TP", 1.0).otherwise(0.0)
    return judged.withColumn("score", score)


def score_cells(cells: DataFrame, threshold: Column | float = 0.5, nfc: bool = True) -> DataFrame:
    return judge(read_predictions(cells, nfc), threshold)


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def n(outcome: str) -> Column:
    return count_if(F.col("outcome") == outcome)


def ratio(above: Column, below: Column) -> Column:
    """0 where there is nothing to divide by; six places, so that engines agree."""
    return F.round(F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0)), 6)


def f1(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", prefix: str = "") -> DataFrame:
    """Precision, recall and F1 columns from counts."""
    t, p, r = (F.col(c) for c in (tp, fp, fn))
    return df.withColumns({f"{prefix}precision": ratio(t, t + p), f"{prefix}recall": ratio(t, t + r), f"{prefix}f1": ratio(2 * t, 2 * t + p + r)})


COUNTS = [("TP", "tp"), ("FP", "fp"), ("FN", "fn")]


def outcome_counts(cells: DataFrame, *by: str) -> DataFrame:
    return cells.groupBy(*by).agg(*(n(o).alias(c) for o, c in COUNTS))


def micro_macro(cells: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 of each group, and macro F1: the mean over cells that carry a signal."""
    counts = f1(outcome_counts(cells, *by), prefix="micro_")
    return counts.withColumn("macro_f1", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def label_f1(cells: DataFrame, *by: str) -> DataFrame:
    """F1 of each field; fields without a signal are left out."""
    return f1(outcome_counts(cells.filter(F.col("outcome").isin("TP", "FP", "FN")), *by, "field_key"))


def presence_f1(cells: DataFrame, *by: str) -> DataFrame:
    """F1 over cells that are stored and were not rejected."""
    return f1(outcome_counts(cells.filter(F.col("gt_present") & (F.col("outcome") != "EXCLUDED")), *by), prefix="presence_")


def spurious_rate(cells: DataFrame, *by: str) -> DataFrame:
    """Share of absent cells for which something was said."""
    absent = cells.filter(~F.col("gt_present")).groupBy(*by).agg(n("FP").alias("n_spurious"), F.count("*").alias("n_absent"))
    return absent.withColumn("spurious_rate", ratio(F.col("n_spurious"), F.col("n_absent")))


def group_level_f1(cells: DataFrame, *by: str) -> DataFrame:
    """All-or-nothing F1 of field groups: judged document by document, then summed."""
    signal = cells.filter((F.col("field_group") != "") & F.col("outcome").isin("TP", "FP", "FN"))
    group = outcome_counts(signal, *by, "doc_id", "field_group")
    whole = (F.col("fp") == 0) & (F.col("fn") == 0)
    wrong = ~whole & ((F.col("tp") > 0) | (F.col("fn") > 0))
    return f1(group.groupBy(*by).agg(count_if(whole).alias("g_tp"), count_if(~whole).alias("g_fp"), count_if(wrong).alias("g_fn")), "g_tp", "g_fp", "g_fn", "group_")


def outcome_pivot(cells: DataFrame, *by: str) -> DataFrame:
    """A count for each of the five outcomes, zeros included."""
    return cells.groupBy(*by).agg(*(n(o).alias(f"n_{o.lower()}") for o in OUTCOMES))


def score_heatmap(cells: DataFrame, *by: str) -> DataFrame:
    """Mean score over cells that carry a signal."""
    return cells.filter(F.col("outcome").isin("TP", "FP", "FN")).groupBy(*by).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n_cells"))


def rollup_f1(cells: DataFrame, by: str, total: str = "POOLED") -> DataFrame:
    """F1 of each value of ``by`` and of all together, in one pass."""
    counts = cells.rollup(by).agg(*(n(o).alias(c) for o, c in COUNTS), F.grouping(by).alias("all_of_them"))
    return f1(counts.withColumn(by, F.when(F.col("all_of_them") == 1, total).otherwise(F.col(by))).drop("all_of_them"))


def threshold_sweep(read: DataFrame, thresholds: list[float], *by: str) -> DataFrame:
    """Micro F1 at each threshold and the span between them: thresholds multiply columns, not rows."""
    judged = {t: judge(read, t).outcome for t in thresholds}
    out = read.select(*by, "field_type", "gt_norm", "pred_norm", "gt_present", "nls")
    names = {}
    for t in judged:
        name = f"{t:.2f}".replace(".", "_")
        out = judge(out, t).withColumnRenamed("outcome", f"o_{name}").drop("score")
        names[t] = name
    sums = [count_if(F.col(f"o_{m}") == o).alias(f"{c}_{m}") for m in names.values() for o, c in COUNTS]
    counts = out.groupBy(*by).agg(*sums)
    scores = {f"f1_{m}": ratio(2 * F.col(f"tp_{m}"), 2 * F.col(f"tp_{m}") + F.col(f"fp_{m}") + F.col(f"fn_{m}")) for m in names.values()}
    counts = counts.withColumns(scores)
    span = F.greatest(*scores) - F.least(*scores)
    return counts.select(*by, *scores, F.round(span, 6).alias("span"))
